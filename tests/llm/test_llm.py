import bisect
import functools
import hashlib
import math
import random
import re
import time
from collections import Counter, deque

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import decontaminate, html_text, language_id, mixing, near_dedup, quality_model, quality_rules, sharding, token_counts, url_filter
from paperloom.llm.blocks import blocks_of
from paperloom.llm.queries import ORACLE_SQL, QUERIES, TOKENIZER
from sqlcheck import SF, compare

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, block int, start long, n long"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None, 1, 2, 3) for i, t, s in rows], DOCS)


def words(n, seed):
    rng = random.Random(seed)
    return [rng.choice(["the", "of", "and", "in"]) + str(rng.randrange(400)) for _ in range(n)]


EDGES = [(1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, "one two", "b"), (4, "one two", "b"), (None, "three four five six seven eight", None), (5, " ".join(words(30000, 1)), "a")]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name])


def brute_components(rows):
    sets = []
    for i, t, _ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    label = {i: i for i, _ in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b) and label[i] > label[j]:
                    label[i], changed = label[j], True
    return label


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    base, rows = words(120, 2), list(EDGES)
    for k in range(40):  # copies with more and more edits, some beyond the threshold
        w = list(base)
        for _ in range(k // 6):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((100 + k, " ".join(w), "a"))
    for k in range(20):
        w = words(9, 50 + k // 4)
        rows.append((200 + k, " ".join(w + ["x"] * (k % 4)), "b"))
    got = near_dedup.near_duplicates(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute_components(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert near_dedup.near_duplicates(docs_of(spark, [])).count() == 0


def test_short_links_need_no_bucket(spark):
    # texts of eight words and their first seven (3 of 4 shingles alike), without a common bucket
    rows, step = [], 0
    while len(rows) < 4 and step < 200:
        texts = [f"{step}w{k}a {k}b c d e f g{k} h" for k in range(2000)]
        sets = [np.sort(x) for x in np.split(*(lambda h, at: (h, at[1:-1]))(*decontaminate._block(texts).shingles(5)))]
        for t, own in zip(texts, sets):
            less = np.sort(decontaminate._block([t.rsplit(" ", 1)[0]]).shingles(5)[0])
            if len(rows) < 4 and not len(np.intersect1d(near_dedup.bucket_keys(own), near_dedup.bucket_keys(less))):
                rows += [(2 * len(rows) + 1, t, "a"), (2 * len(rows) + 2, t.rsplit(" ", 1)[0], "a")]
        step += 1
    assert len(rows) == 4
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_longer_links_share_a_bucket():
    assert (1 - 0.75**near_dedup.ROWS) ** near_dedup.BANDS < 1e-6


def test_a_centre_of_several_sets_keeps_all(spark):
    a, b = words(90, 31), words(90, 32)
    rows = [(1, " ".join(a), "a"), (1, " ".join(b), "a"), *((10 + k, " ".join([*a[:89], f"x{k}"]), "a") for k in range(6)), *((20 + k, " ".join([*b[:89], f"x{k}"]), "a") for k in range(6))]
    got = near_dedup.near_duplicates(docs_of(spark, rows)).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {1}


def test_signature_agreement_estimates_similarity():
    from paperloom.llm.blocks import constants

    x = constants(1500, 77)
    a, b = np.sort(x[:1000]), np.sort(x[200:1200])
    agree = (near_dedup.signature(a) == near_dedup.signature(b)).mean()
    assert abs(agree - 800 / 1200) < 4 * math.sqrt(0.25 / near_dedup.BINS)
    assert near_dedup.signature(a[:3]).all()


def test_mix_meets_targets(spark):
    rows = list(EDGES) + [(1000 + i, " ".join(words(1 + i % 70, i)), f"s{i % 3}") for i in range(400)]
    docs = docs_of(spark, rows).select("doc_id", "source", mixing.count_words(F.col("text")).alias("size"), F.lit(1).alias("block"))
    got = mixing.taken_words(docs, block_words=64).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        s = by.setdefault(r.source, [0, r.source_size, r.target])
        s[0] += r.taken
    # water filling by repeated sharing
    names = sorted((k for k in by if k is not None)) + [None]
    weight, left, fixed = {k: i % 3 + 1 for i, k in enumerate(names)}, set(names), {}
    total = sum(by[k][1] for k in names)
    while True:
        level = (total - sum(fixed.values())) / sum(weight[k] for k in left)
        over = [k for k in left if level * weight[k] > 3 * by[k][1]]
        if not over:
            break
        for k in over:
            fixed[k] = 3 * by[k][1]
            left.remove(k)
    for k in names:
        assert math.isclose(by[k][2], fixed.get(k, level * weight[k]), rel_tol=1e-9)
        assert abs(by[k][0] - by[k][2]) <= 0.5
    assert mixing.taken_words(docs.limit(0)).count() == 0


def test_schedule_is_low_discrepancy(spark):
    sources = spark.createDataFrame([("a", 64000, 1, 16000.0), ("b", 64000, 3, 48000.0)], "source string, source_size long, weight long, target double")
    slots = [r.source for r in mixing.schedule(sources, 64).orderBy("slot").collect()]
    assert Counter(slots) == {"a": 250, "b": 750}
    for n in range(50, 1000, 50):
        assert abs(slots[:n].count("a") - n / 4) < 8


def test_shards_are_full_rings(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ARC_ROWS", 1)
    rows = [(i, f"t{i}", "a") for i in range(9003)] + EDGES + [(None, f"no id {i}", "a") for i in range(3000)]
    docs = docs_of(spark, rows).withColumn("low", F.lit(0)).withColumn("shard", F.lit("x"))
    got = sharding.assign_shards(docs, "doc_id", 24, order_by=("text",)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(24))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.assign_shards(docs_of(spark, []), "doc_id", 24).count() == 0


def walked(ids, shards, vnodes):
    """Shards of documents by a walk round the ring, one document after the other."""
    place = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    points = sorted((place(f"shard/{s}/{v}"), s) for s in range(shards) for v in range(vnodes))
    places = [p for p, _ in points]
    arcs = [[] for _ in points]
    for place_, i in sorted((place(str(i)), i) for i in ids):
        arcs[bisect.bisect_left(places, place_) % len(points)].append(i)
    quota = [len(ids) // shards + (s < len(ids) % shards) for s in range(shards)]
    total, seen, before, turn = Counter(), Counter(), Counter(), Counter()
    for arc, (_, s) in zip(arcs, points):
        total[s] += len(arc)
    capacity = []
    for arc, (_, s) in zip(arcs, points):
        seen[s] += len(arc)
        turn[s] += 1
        goal = math.floor(quota[s] * (seen[s] / total[s])) if total[s] > quota[s] else seen[s] + math.floor((quota[s] - total[s]) * (turn[s] / vnodes))
        capacity.append(goal - before[s])
        before[s] = goal
    out = {i: points[k][1] for k, arc in enumerate(arcs) for i in arc[: capacity[k]]}
    waiting, room = deque(), [max(0, c - len(a)) for c, a in zip(capacity, arcs)]
    for step in range(2 * len(points)):  # the second round finds room for those that came before it
        k = step % len(points)
        if step < len(points):
            waiting.extend(arcs[k][capacity[k] :])
        while waiting and room[k]:
            room[k] -= 1
            out[waiting.popleft()] = points[k][1]
    return out, arcs, points


@pytest.mark.parametrize("arc_rows", [4096, 60, 1])
def test_shards_equal_a_walk_round_the_ring(spark, monkeypatch, arc_rows):
    """Every document is where the walk puts it, whether an arc is ranked in one chunk or in many."""
    monkeypatch.setattr(sharding, "ARC_ROWS", arc_rows)
    ids = range(3001)
    docs = docs_of(spark, [(i, "t", "a") for i in ids])
    got = {r.doc_id: r.shard for r in sharding.assign_shards(docs, "doc_id", 7, vnodes=16).collect()}
    want, arcs, points = walked(ids, 7, 16)
    own = {i: points[k][1] for k, arc in enumerate(arcs) for i in arc}
    assert got == want and sum(want[i] != own[i] for i in ids) > 100
    # limited movement: few documents change their shard when one more comes
    more = {r.doc_id: r.shard for r in sharding.assign_shards(docs, "doc_id", 8, vnodes=16).collect()}
    assert sum(got[i] != more[i] for i in ids) < 0.4 * len(ids)


def test_quality_rules_edges(spark):
    rep = "a b c d e f g h "
    rows = list(EDGES) + [(7, rep * 4, "h"), (8, "x\nx\n y\nx #$|", "h"), (9, rep + "z " + rep, "h")]
    got = {r.doc_id: r for r in quality_rules.judge(docs_of(spark, rows).withColumnRenamed("source", "host")).collect()}
    assert (got[7].n_words, got[7].n_repeat_words, got[7].base_failed) == (32, 32, True)
    assert (got[8].n_dup_lines, got[8].n_symbols, got[8].word_chars) == (1, 3, 7)
    assert (got[9].n_repeat_words, got[1].n_words, got[1].kept) == (16, 0, False)
    assert quality_rules.judge(docs_of(spark, []).withColumnRenamed("source", "host")).count() == 0


def test_quality_rules_beyond_the_base(spark):
    plain = " ".join(words(60, 1))
    bad = {20: plain + " #" * 7, 21: "of it " * 2 + " ".join(f"{a}{b}" for a in "abcdefg" for b in "hijklm"), 22: " ".join(w * 3 for w in words(40, 2)), 23: "\n".join([" ".join(words(60, 3))] + ["a line that is here"] * 4)}
    rows = [(1, plain, "good"), *((i, t, "good") for i, t in bad.items()), *((100 + i, plain, "good") for i in range(200)), *((400 + i, " ".join(words(60, i)) + " #" * 7, "bad") for i in range(190)), *((700 + i, plain, "bad") for i in range(10))]
    got = {r.doc_id: r for r in quality_rules.judge(docs_of(spark, rows).withColumnRenamed("source", "host")).collect()}
    assert len(got) == len(rows)
    assert all(got[i].rule_failed and not got[i].base_failed and not got[i].kept for i in bad)
    assert got[20].symbols_failed and got[21].length_failed and got[22].length_failed and got[23].lines_failed
    assert got[1].kept and got[100].kept
    # the clean documents of a host that fails by one rule go too
    assert not any(got[700 + i].rule_failed or got[700 + i].host_kept or got[700 + i].kept for i in range(10))


def test_host_rates_equal_a_plain_fit(spark):
    counts = {"good": (205, 5, 0), "bad": (200, 190, 3), "new": (1, 1, 0), None: (40, 4, 40)}
    rows = [(h, i < base, i < symbols, False, False) for h, (n, base, symbols) in counts.items() for i in range(n)]
    got = {(r.host, r.rule): r for r in quality_rules.host_rates(spark.createDataFrame(rows, "host string, base_failed boolean, symbols_failed boolean, length_failed boolean, lines_failed boolean")).collect()}
    assert len(got) == 16
    for rule, failed in (("base_failed", {h: c[1] for h, c in counts.items()}), ("symbols_failed", {h: c[2] for h, c in counts.items()}), ("lines_failed", dict.fromkeys(counts, 0))):
        n = {h: c[0] for h, c in counts.items()}
        m = sum(failed.values()) / sum(n.values())
        spread = sum(n[h] * (failed[h] / n[h] - m) ** 2 for h in n)
        room = sum(n.values()) - len(n) - sum(x * x for x in n.values()) / sum(n.values()) + 1
        rho = (spread - (len(n) - 1) * m * (1 - m)) / (m * (1 - m) * room) if m else 0
        strength = max(1 / rho - 1, 1) if rho > 1 / 1001 else 1000
        limit = max(0.2, 3 * m / (1 - m) / (1 + 3 * m / (1 - m)))
        for h in n:
            rate = (failed[h] + m * strength) / (n[h] + strength)
            assert math.isclose(got[h, rule].rate, rate, rel_tol=1e-9, abs_tol=1e-12) and got[h, rule].rule_kept == (rate <= limit)
    assert not got["bad", "base_failed"].rule_kept and got["good", "base_failed"].rule_kept and not got[None, "symbols_failed"].rule_kept


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "Which river crosses the old northern town of Arlen? The slow Brenta."), (2, "How many sides has a regular figure called the heptagon? Seven."), (3, None)], "item_id long, text string")
    filler = " ".join(words(600, 9))
    rows = list(EDGES) + [(10, f"{filler} which RIVER crosses the old northern town of Arlen? The slow Brenta. {filler}", "a"), (11, "how many sides has a regular thing?", "a"), (12, "How many sides has a regular figure called the heptagon?\n\nseven", "a")]
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(spark, rows), items).collect()) == [(10, 1), (12, 2)]
    assert decontaminate.contaminated(docs_of(spark, rows), items.limit(0)).count() == 0
    assert decontaminate.contaminated(docs_of(spark, []), items).count() == 0


def exhaustive(items, texts, least):
    """Scores of all passages against all items, by the formula of BM25: {(text, passage, item): share}."""
    docs = [(i, f"{q} {a}".split()) for i, q, a in items]
    mean, df, size = sum(len(w) for _, w in docs) / len(docs), Counter(t for _, w in docs for t in set(w)), max(len(w) for _, w in docs)
    table = []
    for i, w in docs:
        k = 1.2 * (0.25 + 0.75 * len(w) / mean)
        score = {t: math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + k) for t, f in Counter(w).items()}
        table.append((i, {t: x / sum(score.values()) for t, x in score.items()}))
    out = {}
    for n, text in enumerate(texts):
        w = text.split()
        cells = [set(w[k : k + size]) for k in range(0, max(1, len(w)), size)]
        for c in range(max(1, len(cells) - 1)):
            terms = cells[c] | (cells[c + 1] if c + 1 < len(cells) else set())
            out |= {(n, c, i): x for i, s in table if (x := sum(v for t, v in s.items() if t in terms)) >= least - 1e-6}
    return out


@pytest.mark.parametrize("dense", [0, 1 << 21])
def test_the_index_retrieves_what_an_exhaustive_search_does(monkeypatch, dense):
    monkeypatch.setattr(decontaminate, "_DENSE", dense)
    monkeypatch.setattr(decontaminate, "STEP", 500)
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(250)]
    often = [1 / (i + 1) for i in range(250)]
    items = [(i, " ".join(rng.choices(vocabulary, often, k=rng.randrange(4, 30))), "end of it") for i in range(120)]
    texts = [" ".join(rng.choices(vocabulary, often, k=rng.randrange(0, 200)) + (items[rng.randrange(120)][1].split() if k % 2 else [])) for k in range(80)] + ["", "end of it"]
    index, block = decontaminate.Index(items), decontaminate._block(texts)
    got = {(d, (low - int(block.first[d])) // index.longest, int(index.ids[i])): s for d, low, _, i, s in zip(*(x.tolist() for x in index.hits(block)))}
    want = exhaustive(items, texts, 0.6)
    assert len(want) > 200 and set(got) == set(want) and all(math.isclose(got[k], want[k]) for k in want)


def test_lightly_edited_items_are_found(spark):
    items = spark.createDataFrame([(i, " ".join(words(25, i)) + ". " + " ".join(words(9, 100 + i))) for i in range(20)], "item_id long, text string")
    rng, rows = random.Random(3), []
    for r in items.collect():
        for k in range(4):
            w = r.text.split()
            w[rng.randrange(len(w))] = "edited"
            rows.append((100 * r.item_id + k, " ".join([*words(80, 500 + k), *w, *words(200, 600 + k)]), "a"))
        rows.append((100 * r.item_id + 50, " ".join([*words(80, 7), *r.text.split()[:25], *words(50, 8)]), "a"))  # the question alone
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(spark, rows), items).collect()}
    assert got == {(i, i // 100) for i, _, _ in rows if i % 100 < 50}


def test_items_that_are_equal_are_all_found_in_very_long_texts(spark):
    items = spark.createDataFrame([(1, "what is the name of the river there? the slow brenta"), (2, "what is the name of the river there? the slow brenta"), (4, " "), (None, "x")], "item_id long, text string")
    long = " ".join(words(60000, 1)) + " What is the name of the river there? The slow Brenta " + " ".join(words(60000, 2))
    rows = [(1, long, "a"), (1, long, "a"), (2, " ".join(words(500, 3)), "a"), (None, long, "a")]
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(spark, rows).withColumn("item_id", F.lit(9)).withColumn("score", F.lit("x")), items).collect())
    assert got == Counter({(1, 1): 2, (1, 2): 2, (None, 1): 1, (None, 2): 1})


def test_quality_model_learns(spark):
    good, bad = words(60, 3), [w + "***" for w in words(60, 4)]
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(good if i % 2 else bad, k=40)), "a") for i in range(200)]
    docs = docs_of(spark, rows + EDGES)
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, label int")
    model = quality_model.fitted(docs, labels)
    score = {r.doc_id: r.score for r in quality_model.scored(docs, model).collect()}
    assert sum((score[i] >= 0.5) == bool(i % 2) for i in range(100, 200)) >= 98
    assert all(0 <= s <= 1 for s in score.values())
    assert quality_model.scored(docs.limit(0), quality_model.fitted(docs, labels.limit(0))).count() == 0


def test_language_id(spark):
    text = {"en": "the house of the old man and the sea ", "fr": "la maison du vieil homme et la mer elle ", "de": "das haus des alten mannes und das meer ", "es": "la casa del viejo hombre y el mar que "}
    rows = [(i, text[k] * (1 + i % 5), k, k if i % 7 else None, f"h{k}") for i, k in enumerate(list(text) * 30)] + [(900, None, None, "en", "hen"), (901, "12 34 !!", None, "en", None), (902, "", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, truth string, declared string, host string").withColumn("suffix", F.lit(None).cast("string"))
    got = {r.doc_id: r for r in language_id.identified(df).collect()}
    assert len(got) == len(rows) and all(got[i].language == k and got[i].kept for i, _, k, _, _ in rows if k)
    assert all(not got[i].kept and got[i].language is None for i in (900, 901, 902))
    assert language_id.identified(df.limit(0)).count() == 0


def test_language_id_rejects_other_languages(spark):
    text = {"en": "the house of the old man and the sea ", "fr": "la maison du vieil homme et la mer elle ", "de": "das haus des alten mannes und das meer ", "es": "la casa del viejo hombre y el mar que "}
    rng = random.Random(4)
    gibberish = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(40))
    other = ["все люди рождаются свободными и равными " * 4, "人人生而自由在尊严和权利上一律平等" * 6, gibberish, "wszyscy ludzie rodza sie wolni i rowni pod wzgledem swej godnosci " * 3]
    rows = [(i, text[k] * (1 + i % 5), k if i % 3 else f"{k}-XX", f"h{k}") for i, k in enumerate(list(text) * 30)]
    rows += [(500 + i, t, d, h) for i, (t, d, h) in enumerate((t, d, h) for t in other for d, h in ((None, None), ("ru", "x"), ("und", "hen")))]
    rows += [(900, "   \n \t  ", None, "hen"), (901, "12 34   56", "en", "hen"), (902, "\u2026\u2026 \u2014\u2014 \u00bf\u00bf", "en", "hen"), (903, "qua", "it", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string").withColumn("suffix", F.lit(None).cast("string"))
    got = {r.doc_id: r for r in language_id.identified(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept and got[i].language == d[:2] for i, _, d, _ in rows if i < 500)
    assert all(r.language == "other" and not r.kept for i, r in got.items() if 500 <= i < 900)
    assert all(got[i].language is None and got[i].n_grams == 0 and not got[i].kept for i in (900, 901, 902))
    assert not got[903].kept
    only = {r.doc_id: r.kept for r in language_id.identified(df, keep=("de",)).collect()}
    assert {i for i, kept in only.items() if kept} == {i for i, _, d, _ in rows if i < 500 and d[:2] == "de"}


def test_token_counts_equal_plain_spelling(spark):
    pieces = token_counts.pieces_of(TOKENIZER)
    longest = max(map(len, pieces))
    rows = EDGES[:6] + [(20, "Étion naïve 王 \U0001f600 unbelievable " + "x" * 500, "a"), (21, " ".join(words(50, 8)), "a")]
    for r in token_counts.counted(docs_of(spark, rows), TOKENIZER).collect():
        texts = [t for i, t, _ in rows if i == r.doc_id]
        w = re.findall(rb"[^\x20\x09-\x0D]+", (texts[0] or "").encode())
        assert (r.n_words, r.n_tokens) == (len(w), sum(token_counts.spelled(token_counts.MARK + x, pieces, longest) for x in w))
    assert token_counts.counted(docs_of(spark, []), TOKENIZER).count() == 0


def test_url_filter(spark):
    urls = {"http://a.NET/x": ("a.net", "block"), "http://sub.example.net/en/1?q": ("sub.example.net", "allow"), "http://x.net": ("x.net", "allow"), "https://casino.org/fr": ("casino.org", "block"), "https://casinola.org/": ("casinola.org", "allow"), "https://free-bets.org/": ("free-bets.org", "block"), "https://free-free.org/": ("free-free.org", "allow"), "no scheme": ("", "allow"), None: ("", "allow"), "": ("", "allow")}
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = (("block", "net/"), ("allow", "example.net/en/"))
    got = {r.url: (r.host, r.verdict) for r in url_filter.judged(df, rules).collect()}
    assert got == urls
    assert url_filter.judged(df.limit(0), rules).count() == 0


def test_url_filter_reads_long_and_repeated_addresses(spark):
    long = "http://a.org/" + "x/" * 200_000
    rows = [(1, long + "casino"), (2, long + "casinox"), (3, "http://a.org/xxx"), (3, "http://a.org/xxx"), (4, "http://A.ORG/Win-BET")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "strict_hits": F.lit("x"), "other": F.lit(2)})
    got = Counter((r.page_id, r.verdict, r.other) for r in url_filter.judged(df).collect())
    assert got == Counter({(1, "block", 2): 1, (2, "allow", 2): 1, (3, "block", 2): 2, (4, "block", 2): 1})


def test_url_terms_equal_a_search_by_words(spark):
    urls = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()] + [f"http://x.org/{a}-{b}_{c}" for a in ("win", "winx", "poker") for b in ("poker", "1poker", "bet") for c in ("win", "sale", "porn", "porn2")]
    got = url_filter.judged(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    for r in got:
        held = set(re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.url or "")))
        soft = held & set(url_filter.SOFT)
        assert (r.strict_hits, r.soft_hits, r.soft_weight) == (len(held & set(url_filter.STRICT)), len(soft), sum(url_filter.SOFT[t] for t in soft)), r.url


def fused(rows, n):
    """The posterior of each row by Bayes' rule, from its text's log-likelihoods: rows (log, declared, host, suffix)."""
    share = []
    for log, *_ in rows:
        w = [math.exp(x) for x in log]
        share.append([x / sum(w) for x in w])
    total = lambda test: [sum(s[i] for s, r in zip(share, rows) if test(r)) for i in range(n)]
    smooth = lambda own, above, strength: [(x + strength * y) / (sum(own) + strength) for x, y in zip(own, above)]
    every = total(lambda r: True)
    top = [(x + 1) / (sum(every) + n) for x in every]
    out = []
    for log, declared, host, suffix in rows:
        prior = smooth(total(lambda r: r[2:] == (host, suffix)), smooth(total(lambda r: r[3] == suffix), top, language_id.SUFFIX_STRENGTH), language_id.HOST_STRENGTH)
        said = [1.0] * n if declared is None else [language_id.DECLARED_RIGHT if i == declared else (1 - language_id.DECLARED_RIGHT) / (n - 1) for i in range(n)]
        w = [math.exp(x) * p * d for x, p, d in zip(log, prior, said)]
        out.append(max((x / sum(w), i) for i, x in enumerate(w)))
    return out


def test_language_fusion_equals_bayes_rule_by_hand(spark, monkeypatch):
    names = (*language_id.LANGUAGES, language_id.OTHER)
    rng = random.Random(8)
    rows = [([-rng.random() * 6 for _ in names], rng.choice([None, 0, 1, 4]), rng.choice([None, "a", "b"]), rng.choice([None, "de", "org"])) for _ in range(60)]
    # texts of one word each stand for their likelihoods
    logs = {f"text{i}x": r[0] for i, r in enumerate(rows)}

    def likelihoods(table, floor):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                flat = [logs[t] for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "declared", "host", "suffix")), pa.array([1] * len(flat), pa.int64()), pa.array(flat, pa.list_(pa.float64()))], ["doc_id", "declared", "host", "suffix", "n_grams", "log"])

        return run

    monkeypatch.setattr(language_id, "_likelihoods", likelihoods)
    code = [*language_id.LANGUAGES, "ru"]
    df = spark.createDataFrame([(i, f"text{i}x", None if d is None else code[d], h, s) for i, (_, d, h, s) in enumerate(rows)], "doc_id long, text string, declared string, host string, suffix string")
    got = {r.doc_id: r for r in language_id.identified(df).collect()}
    for i, (confidence, k) in enumerate(fused(rows, len(names))):
        assert got[i].language == names[k] and math.isclose(got[i].confidence, confidence, rel_tol=1e-9)


def test_language_is_known_without_being_declared(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.length("text") > 200)
    # a third of the rows declare nothing; their own lang is the truth
    hidden = F.col("doc_id") % 3 == 0
    seen = docs.select("doc_id", "text", F.when(~hidden, F.col("lang")).alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))
    got = language_id.identified(seen).join(docs.where(hidden).select("doc_id", "lang"), "doc_id")
    right, n = got.select(F.count_if(F.col("language") == F.col("lang")), F.count("*")).first()
    assert n > 150 and right / n > 0.97


def test_language_of_pages_and_odd_rows(spark):
    got = QUERIES["language_id_pages"](spark, SF)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert got.count() == pages.count() and {r.language for r in got.collect()} <= {*language_id.LANGUAGES, language_id.OTHER, None}
    assert set(got.columns) == {"page_id", "n_grams", "language", "confidence", "kept"}
    rows = [(i, "the house of the old man and the sea " * (1 + i % 3), "en", "h") for i in range(40)] + [(1, "the house of the old man and the sea " * 40_000, None, None)] * 2 + [(None, "the old man and the sea", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string").withColumns({"suffix": F.lit(None).cast("string"), "language": F.lit(1), "prior": F.lit(2), "log": F.lit(3)})
    out = language_id.identified(df).collect()
    assert len(out) == len(rows) and all(r.language == "en" and r.kept for r in out)


def test_quality_model_equals_plain_loops():
    rng = np.random.default_rng(3)
    rows = [(int(i % 2), np.sort(rng.choice(500, 30, replace=False)).astype(np.int32), rng.integers(1, 5, 30).astype(np.float32)) for i in range(12)]
    model = quality_model.Model(seed=0).fit(rows, epochs=2, rate=0.3, seed=0)
    start = quality_model.Model(seed=0)
    table, out, bias = start.table.astype(float).tolist(), [[0.0, 0.0] for _ in range(quality_model.DIM)], [math.log(7 / 14), math.log(7 / 14)]
    draw, steps = np.random.default_rng(0), 24
    for step in range(steps):
        if step % 12 == 0:
            order = draw.permutation(12)
        label, ids, counts = rows[order[step % 12]]
        share = [c / sum(counts) for c in counts]
        mean = [sum(s * table[i][d] for s, i in zip(share, ids)) for d in range(quality_model.DIM)]
        odds = [sum(mean[d] * out[d][k] for d in range(quality_model.DIM)) + bias[k] for k in (0, 1)]
        whole = sum(math.exp(x) for x in odds)
        p = [(math.exp(x) / whole - (k == label)) * 0.3 * (1 - step / steps) for k, x in enumerate(odds)]
        back = [sum(out[d][k] * p[k] for k in (0, 1)) for d in range(quality_model.DIM)]
        for d in range(quality_model.DIM):
            for k in (0, 1):
                out[d][k] -= mean[d] * p[k]
            for s, i in zip(share, ids):
                table[i][d] -= s * back[d] * 20
        bias = [b - 0.01 * x for b, x in zip(bias, p)]
    assert np.allclose(model.out, out, atol=1e-4) and np.allclose(model.bias, bias, atol=1e-5)
    assert np.allclose(model.table[:500], [table[i] for i in range(500)], atol=1e-4)
    weight, constant = model.weights()
    assert np.allclose(weight[:500], [sum(table[i][d] * (out[d][1] - out[d][0]) for d in range(quality_model.DIM)) for i in range(500)], atol=1e-4) and math.isclose(constant, bias[1] - bias[0], abs_tol=1e-5)


def test_a_score_is_the_average_of_its_features(spark):
    rng = np.random.default_rng(5)
    model = quality_model.Model()
    model.out = rng.normal(size=model.out.shape).astype(np.float32)
    model.table = rng.normal(size=model.table.shape).astype(np.float32)
    weight, constant = model.weights()
    texts = ["one two two three", "naïve  x", "", None, "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality_model.scored(docs, model).collect()}
    for i, text in enumerate(texts):
        w, a, g, b = quality_model.features(next(x for _, _, x in blocks_of(pa.array([text or ""]), lower=False)))
        parts = [float(weight[k]) for k in [*w[a[0] : a[1]], *g[b[0] : b[1]]]]
        size = len((text or "").split()) * (quality_model.PAIRS + 1) + max(0, len((text or "").encode()) - quality_model.GRAM + 1)
        assert len(parts) == size
        odds = sum(parts) / max(1, size) + constant
        assert math.isclose(got[i], 1 / (1 + math.exp(-odds)), rel_tol=1e-5)


def test_token_counts_equal_a_search_of_all_spellings(spark):
    pieces = token_counts.pieces_of(TOKENIZER)
    text = "Étion naïve 王 \U0001f600 unbelievable " + " ".join(words(20, 8)) + " " + "ab" * 60

    @functools.cache
    def best(rest):
        """(score, fewest pieces) of all ways to spell what is left, from the front."""
        if not rest:
            return 0, 0
        ways = ((pieces[rest[:k]], best(rest[k:])) for k in range(1, min(len(rest), 64) + 1) if rest[:k] in pieces)
        return max((a + b, n - 1) for a, (b, n) in ways)

    want = sum(-best(token_counts.MARK + w)[1] for w in text.encode().split())
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    assert [(r.doc_id, r.n_tokens) for r in token_counts.counted(docs, TOKENIZER).collect()] == [(1, want)] * 2


def test_templates_that_are_no_links_make_no_pairs(spark):
    base, rows = words(100, 4), []
    for i in range(2000):
        w = list(base)
        for k in (20, 50, 80):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = near_dedup.stage(docs.mapInArrow(near_dedup._sets, "rep long, set long, own array<long>, parity array<long>").select("rep", "set", F.col("rep").alias("label")), "nodes")
    held = near_dedup._held(docs, nodes, False)
    assert near_dedup.rare_pairs(nodes, held).count() == 0


def test_html_rendering():
    page = """<html><head><title>T &amp; x</title><style>p{}</style></head><body>Hi <b>bold</b> x<p>One<p>Two<ul><li>a<li>b<ul><li>c</ul><li>d</ul>
<ol start=3><li>x<li>y</ol><table><tr><th>Name<th>N<tr><td>Anna<td>1<tr><td>Bo<td>22</table><div hidden>no</div><div style="display: none">no</div><pre>a
  b</pre>line<br>next<script>var t="</p>";</script></body>"""
    title, text, _ = html_text.page_text(page)
    assert title == "T & x"
    assert text == "Hi bold x\n\nOne\n\nTwo\n\n- a\n- b\n  - c\n- d\n\n3. x\n4. y\n\nName | N\nAnna | 1\nBo   | 22\n\na\n  b\n\nline\nnext"
    assert html_text.page_text(None) == (None, "", 0) == html_text.page_text("")
    assert html_text.page_text("just text")[1] == "just text"
    assert html_text.page_text("<div>" * 5000 + "deep")[1] == "deep"


def test_html_tables_lose_no_text():
    cases = {
        "<table>text<tr><td>a<td>b</table>": "text\n\na | b", "<table><tr>text<td>a</table>": "text\na", "<table><tr><form><td>x</td></form></tr></table>": "x",
        "<table><tbody><td>a<td>b</table>": "a | b", "<table><td>a<td>b<tr><td>c</table>": "a | b\nc", "<table><form><tr><td>a</tr></form><tr><td>b</table>": "a\nb",
        "<table><caption>Cap<tr><td>a</table>": "Cap\na", "<table><tr><td>a<table><td>in</table><td>b</table>": "a in | b", "<table>one<b>two</b><div>three</div><tr><td>a</table>": "onetwo\nthree\na",
        "<table><div>" + "<div>" * 3000 + "<tr><td>deep</table>": "deep", "<td>alone": "alone",
    }
    for page, want in cases.items():
        assert re.sub(r"\n+", "\n", html_text.page_text(page)[1]) == re.sub(r"\n+", "\n", want), page[:60]


def test_html_shows_what_is_visible():
    cases = {
        "<table>stray<tr><td>x": "stray\nx", "<tr><div>lost?</div><td>x": "lost?\nx", "<math><mi>x</mi></math> <svg><title>no</title><text>T</text></svg>": "x T",
        "<select><option>a<option>b</select>": "a\nb", '<div style="visibility:hidden">no<b style="visibility: visible">yes</b></div>': "yes", '<p>a<img alt="x>b</p>': "ab",
        "<ol type=a reversed><li>x<li value=7>y</ol>": "b. x\ng. y", "<ol type=I start=9><li>x<li>y</ol>": "IX. x\nX. y", "<ol start=-1><li>x<li>y</ol>": "-1. x\n0. y",
        "<table><tr><td colspan=2>head head head<td>z<tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e</table>": "head head head | z\na | b          | c\n  | d          | e",
        "a < b <3 <!-- x --> c <! y> d": "a < b <3 c d", "<svg><![CDATA[ raw <x> ]]></svg>": "raw <x>", "cut <a href='q": "cut", "<b><td>1</b>2": "12",
        "<input type=submit value=go><input type=hidden value=no>": "go", "<p>one<div>two</div>three": "one\ntwo\nthree",
    }
    for page, want in cases.items():
        assert re.sub(r"\n+", "\n", html_text.page_text(page)[1]) == want, page


@pytest.mark.parametrize("page", ['<a "' * 60000, '<a ="' * 60000, "<div>" * 20000 + "</x>" * 20000, "<table><tr><b><td>" + "<div>" * 20000 + "</b>" * 20000, "<p>" + "<span>" * 20000 + "<div>x</div>" * 20000, "<ul><li>" * 20000, "<table><tr><td>" * 4000, "<!--" * 60000, "<svg>" + "<![CDATA[" * 60000, "<table>" + "<tr><td colspan=1000 rowspan=65534>x" * 3000, "<table><tr><td>" + "w " * 100000 + "<td>z" + "<tr><td>x<td>y" * 10000])
def test_bad_pages_take_time_in_proportion(page):
    began = time.process_time()
    text = html_text.page_text(page)[1]
    assert time.process_time() - began < 8 and len(text) <= 12 * len(page) + 10_000


def test_html_equals_a_plain_renderer():
    rng = random.Random(6)

    def make(depth):
        """(markup, words that are seen, in order)"""
        kind = rng.choice(["text", "text", "div", "p", "b", "hidden", "ul", "comment", "table"]) if depth else "text"
        inner = [make(depth - 1) for _ in range(rng.randrange(1, 4))] if kind != "text" else []
        markup, seen = "".join(m for m, _ in inner), [w for _, ws in inner for w in ws]
        if kind == "text":
            w = f"w{rng.randrange(10**9)}"
            return f" {w}&amp; ", [w + "&"]
        if kind == "hidden":
            return f"<div hidden>{markup}</div>" if rng.random() < 0.5 else f'<i style="display:none">{re.sub("<.*?>", "", markup)}</i>', []
        if kind == "comment":
            return f"<!-- {re.sub('<.*?>|-', '', markup)} -->", []
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{m}" for m, _ in inner) + "</ul>", [x for _, ws in inner for x in ("-", *ws)]
        if kind == "table":
            words_ = [ws for _, ws in inner]
            return "<table><tr>" + "".join(f"<td>{re.sub('<(/?(ul|li|table|tr|td|p|div hidden|div)).*?>', ' ', m) if 'hidden' not in m and '-->' not in m else ws[0] if ws else ''}" for (m, ws) in inner) + "</table>", [x for m, ws in inner for x in ([y for y in ws if y != "-"] if "hidden" not in m and "-->" not in m else ws[:1])] if words_ else []
        return f"<{kind}>{markup}</{kind}>", seen

    for _ in range(150):
        markup, seen = make(4)
        got = html_text.page_text(markup)[1].replace("|", " ").split()
        assert [w for w in got if w != "-"] == [w for w in seen if w != "-"], markup


def test_html_tables(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>"), (1, "<p>a</p>"), (None, None)], "page_id long, html string")
    assert sorted((r.page_id or 0, r.text) for r in html_text.extracted(pages).collect()) == [(0, ""), (1, "a"), (1, "a")]
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_html_columns_are_as_wide_in_large_tables_as_in_small_ones():
    plain = [[(c, 1, "ab") for c in range(300)]]
    spans = [[(0, 2, "x" * 30), (2, 3, "y" * 40), (5, 1, "z")], [(1, 4, "v" * 90), (298, 9, "w" * 50)]]
    few, many = html_text._aligned(spans + plain * 5), html_text._aligned(spans + plain * 400)
    assert many[:7] == few and set(many[2:]) == {few[2]}
    assert few[0].startswith("x" * 30 + " | " + "y" * 40 + " " * 22 + " | z")


def test_pages_are_rendered_a_few_at_a_time(spark):
    pages = spark.createDataFrame([(i, f"<p>a<b>{i}</b>", f"h{i % 3}") for i in range(700)] + [(None, None, None)], "page_id long, html string, host string")
    got = html_text.with_text(pages)
    assert got.columns == ["page_id", "host", "text"]
    assert {(r.page_id, r.host, r.text) for r in got.collect()} == {(i, f"h{i % 3}", f"a{i}") for i in range(700)} | {(None, None, "")}
    (batch,) = [pa.RecordBatch.from_pydict({"html": ["<p>x"] * 700})]
    sizes = []
    stand_in = type("Pages", (), {"schema": pages.select("html").schema, "mapInArrow": lambda self, run, schema: sizes.extend(len(b) for b in run(iter([batch])))})()
    html_text.with_text(stand_in)
    assert sum(sizes) == 700 and max(sizes) <= html_text.PAGES_TOGETHER
