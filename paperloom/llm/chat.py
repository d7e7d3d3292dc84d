"""Chat formatting: conversations are folded from their event logs, then rendered with a loss mask.

A log has one row per event: (conv_id, seq, message, event, role, text). ``message`` is a message's place in its
conversation, ``seq`` the order in which events happened; both may be of any type that can be ordered. Events:

* ``message`` opens a message and names its role;
* ``delta`` appends text;
* ``edit`` replaces all text that the message had before;
* ``regenerate`` discards what the message had before, and every later message's events before it: the conversation
  goes on from there.

Everything is windows and grouped aggregation by conv_id, so a log is shuffled once. A conversation is one row of the
result, so it must fit into a row; no task holds more than the conversation it writes.

Defined cases: an event without seq never happened; the same event delivered twice counts once, different ones of the
same seq count in the order of their texts; null roles and texts are empty; rows without conv_id are one conversation;
a message whose events are all discarded is gone; an empty log gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A turn is ``<turn>role<says>text</turn>`` and a line feed.
TURN, SAYS, END = "<turn>", "<says>", "</turn>"
LEARNED = ("assistant",)
#: Characters of a streamed piece, in logs made from finished messages. A text has fewer than 2^23 of them.
PIECE = 256
_EVENTS_A_MESSAGE = 1 << 24


def escaped(text: Column) -> Column:
    """Text in which no mark of a turn can stand: backslashes are doubled, and one is put behind the ``<`` of a mark."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"<(?=(?:/?turn|says)>)", r"<\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def folded(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) of the messages that stand at the end of the log."""
    kind, seq = F.col("event"), F.col("seq")
    up_to = Window.partitionBy("conv_id").orderBy("message").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    redone = F.max(F.when(kind == "regenerate", seq)).over(up_to)
    edited = F.max(F.when(kind == "edit", seq)).over(Window.partitionBy("conv_id", "message"))
    stands = (seq >= F.coalesce(redone, seq)) & (seq >= F.coalesce(edited, seq))
    log = events.select("conv_id", "message", "seq", "role", F.coalesce("text", F.lit("")).alias("text"), stands.alias("stands"))
    pieces = F.sort_array(F.collect_set(F.when(F.col("stands"), F.struct("seq", "text"))))
    found = log.groupBy("conv_id", "message").agg(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"), pieces.alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    return found.where(F.size("pieces") > 0).select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def rendered(messages: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """(conv_id, formatted, loss_spans): the text of a conversation, and for each turn the span (start, end) of it that is
    learned, in code points; an empty one for turns that aren't."""
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(SAYS))
    turns = messages.select("conv_id", "message", "role", "text", head.alias("head"), escaped(F.col("text")).alias("body"))
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(f"{END}\n")))
    before = Window.partitionBy("conv_id").orderBy("message", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("turn").cast("long")).over(before), F.lit(0))
    turns = turns.select("conv_id", start.alias("at"), "turn", (start + F.char_length("head")).alias("start"), F.when(F.col("role").isin(*learned), F.char_length("body")).otherwise(0).alias("n"))
    span = F.struct("start", (F.col("start") + F.col("n")).alias("end"))
    all_ = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "turn", span.alias("span")))).alias("turns"))
    return all_.select("conv_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), F.transform("turns", lambda t: t["span"]).alias("loss_spans"))


def formatted(events: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """A log's conversations as training texts with their loss masks."""
    return rendered(folded(events), learned)


def read_back(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted_chars, place, role, text, loss_text): the turns of rendered conversations, told from the text
    and its mask alone. Each span is cut from its own turn, so the work grows with the text, whatever the number of turns."""
    parts = F.split("formatted", f"{END}\n")
    turns = conversations.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"), F.posexplode(F.arrays_zip(F.slice(parts, 1, F.size(parts) - 1).alias("part"), F.col("loss_spans").alias("span"))).alias("place", "t"))
    turns = turns.select("conv_id", "formatted_chars", "place", "t.part", "t.span")
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.char_length("part").cast("long") + len(END) + 1).over(before), F.lit(0))
    learned = F.substring("part", (F.col("span.start") - at + 1).cast("int"), (F.col("span.end") - F.col("span.start")).cast("int"))
    role = F.substring_index(F.substring("part", F.lit(len(TURN) + 1), F.char_length("part")), SAYS, 1)
    return turns.select("conv_id", "formatted_chars", "place", unescaped(role).alias("role"), unescaped(F.substring_index("part", SAYS, -1)).alias("text"), unescaped(learned).alias("loss_text"))


def digests(conversations: DataFrame) -> DataFrame:
    """What rendered conversations say, read back: turns, and the text under the loss mask."""
    turn = F.struct("place", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("said"), F.col("loss_text").alias("learned"))
    whole = read_back(conversations).groupBy("conv_id").agg(F.first("formatted_chars").alias("formatted_chars"), F.sort_array(F.collect_list(turn)).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: t["said"]), "")
    learned = F.array_join(F.transform("turns", lambda t: t["learned"]), "")
    whole = whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), learned.alias("learned"), "formatted_chars")
    return whole.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


def streamed(rows: DataFrame) -> DataFrame:
    """The event log of finished conversations (conv_id, turn, role, text), as a chat service would have written it:
    assistant texts come in pieces after a first try that is regenerated, other texts are typed and then edited. Rows of
    one turn are put in the order of their roles and texts; equal rows are messages of their own."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = F.coalesce("text", F.lit(""))
    rows = rows.select("conv_id", F.row_number().over(order).alias("message"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    event = lambda i, kind, text, role=F.lit(None).cast("string"): F.struct(F.lit(i).alias("i") if isinstance(i, int) else i.alias("i"), F.lit(kind).alias("event"), role.alias("role"), text.alias("text"))
    none, draft = F.lit(None).cast("string"), F.substring("text", 1, PIECE // 4)
    begun = [event(0, "message", none, F.col("role")), event(1, "delta", draft)]
    pieces = F.transform(F.regexp_extract_all("text", F.lit(f"(?s)(.{{1,{PIECE}}})")), lambda p, k: event(k + 3, "delta", p))
    events = F.when(F.col("role") == "assistant", F.concat(F.array(*begun, event(2, "regenerate", none)), pieces)).otherwise(F.array(*begun, event(2, "edit", F.col("text"))))
    log = rows.select("conv_id", "message", F.explode(events).alias("e"))
    return log.select("conv_id", (F.col("message") * F.lit(_EVENTS_A_MESSAGE).cast("long") + F.col("e.i")).alias("seq"), "message", "e.event", "e.role", "e.text")
