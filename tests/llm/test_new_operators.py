"""Chat formatting, alignment of tokenizers and hard negatives, against brute force."""

import hashlib
import math
import os
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import align, chat, decontaminate, html_text, negatives
from paperloom.llm.queries import BYTE_TOKENIZER, QUERIES, TOKENIZER
from sqlcheck import SF

DOCS = "doc_id long, text string, a_ids string, n_a string, times int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- chat -------------------------------------------------------------------------------------------------------------

EVENTS = "conv_id long, seq long, message int, event string, role string, text string, place string"


def replayed(events):
    """The log, event by event."""
    seen, state = set(), {}
    for conv, seq, message, event, role, text, _ in sorted((e for e in events if e[1] is not None), key=lambda e: (e[1], e[5] or "")):
        if (conv, seq, message, event, role, text) in seen:
            continue
        seen.add((conv, seq, message, event, role, text))
        messages = state.setdefault(conv, {})
        if event == "regenerate":
            for later in [m for m in messages if m > message]:
                del messages[later]
        own = messages.setdefault(message, [None, ""])
        if role is not None:
            own[0] = role
        own[1] = (text or "") if event in ("edit", "regenerate") else own[1] + (text or "")
    return {(c, m, r or "", t) for c, ms in state.items() for m, (r, t) in ms.items()}


def test_a_log_is_folded_as_when_replayed(spark):
    rng, events, seq = random.Random(3), [], 0
    for conv in (1, 2, 3, None):
        for message in range(6):
            seq += 1
            events.append((conv, seq, message, "message", rng.choice(["user", "assistant", None]), None, "x"))
            for _ in range(rng.randrange(5)):
                seq += 1
                target = rng.randrange(message + 1) if rng.random() < 0.2 else message
                kind = rng.choice(["delta", "delta", "edit", "regenerate"])
                events.append((conv, seq, target, kind, None, rng.choice(["a", "b\n", "", None, "<turn>"]), "x"))
    events += rng.sample(events, 10) + [(1, None, 1, "delta", None, "never", "x")]
    rng.shuffle(events)
    df = spark.createDataFrame(events, EVENTS)
    assert {tuple(r) for r in chat.folded(df).collect()} == replayed(events)
    assert chat.folded(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "</turn>", "<turn>", "<says>", "\\</turn>\\", "<\\/turn>", "<<turn>says>", "</turn>\n<turn>assistant<says>x", "a<b", "\\\\### Assistant: </turn> ok", "ü\U0001f600 <says", "x" * 100_000])
def test_marks_in_texts_are_escaped_and_come_back(spark, text):
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, "<says>\n", text)], "conv_id long, message int, role string, text string")
    out = chat.rendered(df)
    assert out.first().formatted.count("</turn>\n") == 3
    assert [(r.role, r.text, r.loss_text) for r in chat.read_back(out).orderBy("place").collect()] == [("user", text, ""), ("assistant", text, text), ("<says>\n", text, "")]


def test_conversations_come_back_whole(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a" * 1000 + "\\"), (1, 1, "assistant", "a" * 1000 + "\\"), (None, None, None, None), (None, 2, "assistant", "x</turn>"), (2, 0, "system", "")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, event string, seq int")
    got = {r.conv_id: r for r in chat.digests(chat.formatted(chat.streamed(df))).collect()}
    assert set(got) == {1, None, 2}
    long = "a" * 1000 + "\\"
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, 2002, sha(long + long))
    assert got[1].turns_sha256 == sha(f"user\n\nassistant\n{long}\nassistant\n{long}\n")
    assert got[None].turns_sha256 == sha("\n\nassistant\nx</turn>\n") and got[2].loss_sha256 == sha("")
    assert chat.digests(chat.formatted(chat.streamed(df.limit(0)))).count() == 0


# --- alignment --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def plain_tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    a = Tokenizer.from_file(BYTE_TOKENIZER)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)


def plain_alignment(rows, a, b):
    """Every pair of tokens is looked at."""
    found, counts = [], Counter()
    spoken = {a.token_to_id(t): t for t in a.get_vocab()}
    visible = {c: i for i, c in enumerate(chars())}
    for doc_id, text in rows:
        x, y = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bx = [bytes(visible[c] for c in spoken[i]) for i in x]
        by = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in y]
        if b"".join(bx) != f" {text}".encode() or b"".join(by) != b"".join(bx):
            x, y, bx, by = [], [], [], []
        at = lambda tokens: [sum(map(len, tokens[: k + 1])) for k in range(len(tokens))]
        ends_x, ends_y = at(bx), at(by)
        links = [(i, j) for i, e in zip(x, ends_x) for j, f in zip(y, ends_y) if e == f]
        groups, low = [], 0
        for cut in sorted(set(ends_x) & set(ends_y)):
            groups.append(",".join(str(i) for i, e in zip(x, ends_x) if low < e <= cut) + "|" + ",".join(str(j) for j, e in zip(y, ends_y) if low < e <= cut))
            low = cut
        counts.update(links)
        found.append((doc_id, len(x), len(y), len(groups), links, sha(";".join(groups)) if x else ""))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    return sorted((d or -1, n, m, g, len(ls), sum(counts[p] == most[p[1]] for p in ls), sum(counts[p] for p in ls), s) for d, n, m, g, ls, s in found), counts


def chars():
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


def flat(df):
    return sorted((r.doc_id or -1, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_alignment_equals_all_pairs(spark, plain_tokenizers):
    rows = [(1, None), (2, ""), (3, " "), (4, "<|endoftext|> <s> </s> plain"), (5, "naïve \u2581 rewritten"), (6, "日本語 and \U0001f600\n\t\x00 ends"), (7, "  two  blanks\r\n"), (None, "the cat"), (8, "the cat"), (8, "the cat"), (9, "unbelievable internationalization 1234567"), (10, "a" * 300), (11, "e\u0301 ﬁ ½")]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOCS)
    expected, counts = plain_alignment(rows, *plain_tokenizers)
    assert flat(align.alignment(df, BYTE_TOKENIZER, TOKENIZER)) == expected
    found = align.aligned(df, BYTE_TOKENIZER, TOKENIZER)
    assert {(r.a_id, r.b_id): r.n for r in align.pair_counts(found).collect()} == dict(counts)
    assert align.alignment(df.limit(0), BYTE_TOKENIZER, TOKENIZER).count() == 0
    best = {r.b_id: r.n for r in align.vocabulary_map(df, BYTE_TOKENIZER, TOKENIZER).collect()}
    assert best == {j: max(n for (_, k), n in counts.items() if k == j) for _, j in counts}


def test_query_equals_all_pairs(spark, plain_tokenizers):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    kept = [r for r in rows if len(r[1] or "") < 4000]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in kept], DOCS)
    assert flat(align.alignment(df, BYTE_TOKENIZER, TOKENIZER)) == plain_alignment(kept, *plain_tokenizers)[0]
    assert QUERIES["op11_token_alignment"](spark, SF).count() == len(rows)


def test_ids_are_those_of_the_tokenizers_file_for_any_character(plain_tokenizers):
    both = align.tokenizers(BYTE_TOKENIZER, TOKENIZER)
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000][::7]
    for low in range(0, len(points), 200):
        text = "".join(f"a{chr(c)}b {chr(c)}{chr(c)}9\n{chr(c)}'s " for c in points[low : low + 200])
        assert both._a.encode_ordinary(text) == plain_tokenizers[0].encode(text, add_special_tokens=False).ids
    assert both.bound == 324_297


def test_a_very_long_text_is_aligned_whole(spark):
    text = " ".join(f"word{i % 977} é" for i in range(100_000))
    row = align.alignment(spark.createDataFrame([(1, text, "x", "y", 1)], DOCS), BYTE_TOKENIZER, TOKENIZER).first()
    assert row.n_groups == row.n_links > 200_000 and row.n_best > 0


# --- hard negatives ---------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, label int, embedding array<float>, q string, cell int, ids string"


def plain_negatives(rows):
    """Every anchor against every row."""
    kept = {(i, lab, tuple(math.floor(256 * float(x)) for x in v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, lab, v in kept:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in kept)
            mine = [(-s, j) for s, j, other in scored if other == lab and j != i][:5]
            for ps, p in mine:
                window = [(-s, j) for s, j, other in scored if other != lab and 80 * ps <= -100 * s <= 100 * ps][:5]
                out += [(i, p, k + 1, j, ps, s) for k, (s, j) in enumerate(window)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS)
    return sorted(tuple(r) for r in negatives.hard_negatives(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize(("seed", "first", "block"), [(1, 2048, 1024), (2, 40, 16), (3, 1, 8)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed, first, block):
    """Clustered vectors, ties, copies with one label and with several, negative scores, wrong rows; small legs and blocks."""
    monkeypatch.setattr(negatives, "FIRST", first)
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "CELL", block // 8)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 5))
    rows = [(int(i * 10), int(rng.integers(3)), [float(x) for x in np.float32(centres[rng.integers(6)] + 0.2 * rng.normal(size=5))]) for i in range(400)]
    rows += [(5000 + k * 50, k % 2, rows[0][2]) for k in range(40)] + [(9000, 7, [1.0] * 5), (9001, 0, [0.0] * 5), (9100, 0, [0.0] * 5), (9200, 1, [0.5, -0.25])]
    rows += rows[:5] + [(100, 1, rows[3][2])]
    rows += [(None, 1, [1.0] * 5), (9300, None, [1.0] * 5), (9400, 1, None), (9500, 1, [1.0, None, 1.0, 1.0, 1.0]), (9600, 1, [float("nan")] * 5), (9700, 1, [float("inf")] * 5)]
    assert mined(spark, rows) == plain_negatives(rows)


def test_hard_negatives_of_small_and_empty_tables(spark):
    assert mined(spark, []) == mined(spark, [(100, 1, [1.0])]) == mined(spark, [(0, 1, []), (1, 2, [])]) == []
    rows = [(0, 1, []), (1, 1, []), (2, 2, [1.0])]
    assert mined(spark, rows) == plain_negatives(rows) == [(0, 1, 1, 2, 0, 0)]
    large = [(0, 1, [1e5, 1.0]), (1, 1, [1e5, 2.0]), (2, 2, [9e4, 3.0]), (3, 2, [9e4 + 0.25, 3.0])]
    assert mined(spark, large) == plain_negatives(large) != []


def test_the_walk_bounds_every_row(spark, monkeypatch):
    """No row scores above its cell's bound, nor above the sum at which the walk reaches the cell; sums fall; all cells come."""
    monkeypatch.setattr(negatives, "CELL", 4)
    rng = np.random.default_rng(4)
    q = rng.integers(-200, 200, size=(500, 6))
    df = spark.createDataFrame([(int(i % 3), [int(x) for x in v], [i]) for i, v in enumerate(q)], "label int, q array<long>, ids array<long>")
    index, blocks = negatives.build(df)
    cell_of = {int(r.cell): [] for r in blocks.select("cell").collect()}
    for r in blocks.collect():
        cell_of[r.cell] += [v for v in np.frombuffer(bytes(r.vectors), index.kept).reshape(-1, 6)]
    assert sum(map(len, cell_of.values())) == 500
    for query in q[:20]:
        steps = list(negatives.walk(index, query))
        assert sorted(c for _, c, _ in steps) == sorted(cell_of)
        assert all(a[0] >= b[0] for a, b in zip(steps, steps[1:]))
        assert all(v.astype(int) @ query <= min(total, own) for total, cell, own in steps for v in cell_of[cell])
        both = negatives.leg(index, query, 1000, False) + negatives.leg(index, query, 1000, True)
        assert len(set(both)) == len(both) and {c for _, c, own in steps if any(v.astype(int) @ query >= 1000 for v in cell_of[c])} <= set(both)


# --- bounds of rendering ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("markup", ["<script>" + "</script " * 60_000, "<ul><li>x" * 30_000, "<ol><li>word <b>y</b>" * 20_000, "<blockquote>q" * 30_000, "<textarea>" + "</textarea " * 60_000])
def test_bad_pages_take_time_and_output_in_proportion(markup):
    """With text at every level; ten times the page takes about ten times as long."""
    took = []
    for part in (markup[: len(markup) // 8], markup):
        begin = time.process_time()
        out = html_text.page_text(part)[1]
        took.append(time.process_time() - begin)
        assert len(out) <= 12 * len(part)
    assert took[1] < 40 * took[0] + 2


def test_blank_lines_of_preformatted_text_stay():
    assert html_text.page_text("<p>a</p><pre>x\n\n\n\ny</pre><br><br><br>z")[1] == "a\n\nx\n\n\n\ny\n\nz"
    assert html_text.page_text("<p>a<script>var x = '<p>'</script >b<textarea>kept</textarea\n>c")[1].replace("\n", "").startswith("ab")
    text = html_text.page_text("<ul><li>x" * 18)[1].split("\n")
    assert len(text) == 18 and text[15] == " " * 30 + "- x" and text[17] == " " * 30 + "+2 - x"


# --- decontamination: what segments and other items must not change ---------------------------------------------------


def sentences(n, words, seed):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(words)) + " end. Yes " + " ".join(f"w{rng.randrange(3000)}" for _ in range(5)) + ".") for i in range(n)]


def test_segments_and_long_items_change_no_score(spark, monkeypatch):
    items = sentences(60, 20, 1) + [(100 + i, t) for i, t in sentences(4, 300, 2)]
    rng = random.Random(3)
    texts = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(900))) + " " + rng.choice(items)[1] + " tail " * rng.randrange(50)) for i in range(80)]
    docs, table = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    told = lambda items_: {(r.doc_id, r.item_id): (round(r.score, 9), r.question_overlap, r.answer_overlap) for r in decontaminate.retrieved(docs, items_).collect()}
    one = told(table)
    assert len(one) >= 80
    monkeypatch.setattr(decontaminate, "SEGMENT_ITEMS", 9)
    assert told(table) == one


def test_a_long_item_costs_no_more_than_itself():
    """The passages of short items do not grow with the longest."""
    items, long = sentences(200, 30, 4), [(999, " ".join(f"x{i}" for i in range(1500)))]
    lengths = lambda rows: [decontaminate.Index([(i, *decontaminate.question_and_answer(t)) for i, t in part]).longest for part in rows]
    classes = decontaminate.by_length([(i, *decontaminate.question_and_answer(t)) for i, t in items + long])
    assert [len(c) for c in classes] == [200, 1]
    assert [decontaminate.Index(c).longest for c in classes] == lengths([items, long]) == [37, 1500]


def test_what_a_page_hides_is_no_evidence_of_its_language(spark, tmp_path):
    """The same verdicts as from the pages' rendered texts; hidden text and scripts in another language change nothing."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    noise = " der die und nicht eine ist das mit auf den" * 40
    loud = pages.withColumn("html", F.concat("html", F.lit(f"<script>if (a < b) {{ '{noise}' }}</script><div hidden>{noise}</div><template>{noise}</template>")))
    for name, table in (("plain", pages), ("loud", loud)):
        (tmp_path / name).mkdir()
        table.write.parquet(str(tmp_path / name / "pages.parquet"))
    plain, same = ({r.page_id: (r.language, r.kept) for r in QUERIES["language_id_pages"](spark, str(tmp_path / x)).select("page_id", "language", "kept").collect()} for x in ("plain", "loud"))
    assert plain == same and len(plain) == pages.count()
