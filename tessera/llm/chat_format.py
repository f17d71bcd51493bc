r"""Chat formatting by event-sourced reconstruction. DataFrame operations only.

A log has one row per event of a conversation: a message's streamed ``delta``, an ``edit`` that puts
a whole new text in its place, a ``regenerate`` that throws away what was streamed so far, or a
``delete``. Events are partitioned by conversation and message, sorted by sequence number and folded
into the message's final text; messages are then rendered in turn order.

Template: a turn is ``### role: text</turn>`` and a line feed. Inside roles and texts a backslash goes
before every backslash, ``#``, ``:`` (roles only) and the slash of ``</turn>``, so neither control
string can occur there, and dropping one backslash of each pair restores the text exactly.

Scale: the fold's group is one message, so a conversation that holds a third of all events still
spreads over its messages; only its final, rendered form (which is one value by definition) meets in
one row. Events before a message's last edit or regeneration are dropped ahead of the gathering.

Defined results: null texts and roles are empty; events with equal sequence numbers are folded in the
order of kind and text; a repeated delta counts twice, a repeated edit once; a message whose last event is a ``delete`` is left out; a conversation left
without messages does not appear; null conversation ids form one conversation. Several messages of
one turn are told apart by ``msg`` and rendered in its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import table

TURN_END = "</turn>"
TRAINED_ROLE = "assistant"


def escape(text: Column, *, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("#"), F.lit("\\#"))
    out = F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(out, F.lit(":"), F.lit("\\:")) if role else out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(log: DataFrame) -> DataFrame:
    """(conv_id, turn, msg, seq, role, kind, text) events to one row per message: conv_id, turn, msg, role, text."""
    resets = F.col("kind").isin("edit", "regenerate", "delete")
    own = Window.partitionBy("conv_id", "turn", "msg")
    rows = log.select("conv_id", "turn", "msg", "seq", "role", "kind", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("reset", F.max(F.when(resets, F.struct("seq", "kind", "text"))).over(own))
    after = F.col("reset").isNull() | (F.struct("seq", "kind", "text") >= F.col("reset"))
    rows = rows.where(after)
    # what is left are the last reset, maybe repeated, and the deltas after it
    said = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("seq", "kind", "text"))), lambda e: e["kind"] == "delta"), lambda e: e["text"])
    begun = F.coalesce(F.max(F.when(F.col("kind") == "edit", F.col("text"))), F.lit(""))
    folded = rows.groupBy("conv_id", "turn", "msg").agg(
        F.min_by(F.coalesce("role", F.lit("")), F.struct("seq", "kind", "text")).alias("role"),
        F.concat(begun, F.array_join(said, "")).alias("text"),
        F.max_by("kind", F.struct("seq", "kind", "text")).alias("last_kind"),
    )
    return folded.where("last_kind <> 'delete'").drop("last_kind")


def render(messages: DataFrame, trained: str = TRAINED_ROLE) -> DataFrame:
    """Messages to one row per conversation: conv_id, formatted and loss_mask, the (start, length) of each
    text of the trained role in ``formatted``, in code points from 0, in order."""
    head = F.concat(F.lit("### "), escape(F.col("role"), role=True), F.lit(": "))
    rows = messages.select("conv_id", "turn", "msg", (F.col("role") == trained).alias("trained"), head.alias("head"), escape(F.col("text")).alias("body"))
    before = Window.partitionBy("conv_id").orderBy("turn", "msg").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("head") + F.char_length("body") + len(TURN_END) + 1
    start = F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0)) + F.char_length("head")
    rows = rows.select(
        "conv_id", "turn", "msg", "trained", start.alias("start"), F.char_length("body").cast("long").alias("length"),
        F.concat("head", "body", F.lit(TURN_END + "\n")).alias("out"),
    )
    said = F.array_sort(F.collect_list(F.struct("turn", "msg", "trained", "start", "length", "out")))
    whole = rows.groupBy("conv_id").agg(said.alias("said"))
    mask = F.transform(F.filter("said", lambda m: m["trained"]), lambda m: F.struct(m["start"].alias("start"), m["length"].alias("length")))
    return whole.select("conv_id", F.array_join(F.transform("said", lambda m: m["out"]), "").alias("formatted"), mask.alias("loss_mask"))


def under_mask(formatted: Column, mask: Column) -> Column:
    """The texts that the spans of the mask cover, unescaped. The text is cut into chunks first, so that no
    span is counted out from its beginning."""
    size = 4096
    chunks = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))

    def read(held: Column) -> Column:
        def one(span: Column) -> Column:
            first = F.floor(span["start"] / size)
            n = F.floor((span["start"] + span["length"]) / size) - first + 1
            near = F.array_join(F.slice(held["chunks"], (first + 1).cast("int"), n.cast("int")), "")
            return unescape(F.substring(near, (span["start"] - first * size + 1).cast("int"), span["length"].cast("int")))

        return F.transform(held["mask"], one)

    return F.transform(F.array(F.struct(chunks.alias("chunks"), mask.alias("mask"))), read)[0]


def read_back(formatted: Column) -> Column:
    """The rendered text to an array of (role, text), read from the text alone."""
    parts = F.split(formatted, TURN_END + "\n", -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)
    role = lambda t: F.regexp_extract(t, r"(?s)^### ((?:[^\\:]++|\\.)*+): ", 1)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(role(t)).alias("role"),
            unescape(F.substr(t, F.char_length(role(t)) + F.lit(7))).alias("text"),
        ),
    )


def format_chats(log: DataFrame) -> DataFrame:
    """conv_id, the formatted text and the loss mask of every conversation in the log."""
    return render(fold_events(log))


def _as_log(rows: DataFrame) -> DataFrame:
    """Finished turns as the log that could have led to them: every message is streamed in three pieces, and
    by a hash some are begun wrongly and regenerated, some are edited on the way and some are put right
    by a last edit. Events come in no order but that of ``seq``."""
    msg = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = rows.select("conv_id", "turn", msg.alias("msg"), "role", F.coalesce("text", F.lit("")).alias("text"))
    step = F.ceil(F.char_length("text") / 3).cast("int")
    p = [F.substring(F.col("text"), step * i + 1, step) for i in range(3)]
    event = lambda seq, kind, text: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), text.cast("string").alias("text"))
    none = F.lit(None)
    ways = [
        [event(3, "delta", p[2]), event(1, "delta", p[0]), event(2, "delta", p[1])],
        [event(5, "delta", p[2]), event(4, "delta", p[1]), event(3, "delta", p[0]), event(2, "regenerate", none), event(1, "delta", F.reverse(p[0]))],
        [event(3, "delta", p[2]), event(2, "edit", F.concat(p[0], p[1])), event(1, "delta", p[1])],
        [event(4, "edit", F.col("text")), event(1, "edit", p[1]), event(3, "delta", p[0]), event(2, "regenerate", none)],
    ]
    way = F.pmod(F.xxhash64("conv_id", "turn", "msg"), F.lit(len(ways)))
    events = F.when(way == 0, F.array(*ways[0]))
    for k in range(1, len(ways)):
        events = events.when(way == k, F.array(*ways[k]))
    return rows.select("conv_id", "turn", "msg", "role", F.explode(events).alias("e")).select("conv_id", "turn", "msg", "role", "e.*")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TRAINED_ROLE).alias("role"),
        F.lit(said).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = format_chats(_as_log(turns)).withColumn("turns", read_back(F.col("formatted")))
    whole = F.array_join(
        F.transform("turns", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), ""
    )
    read = read.withColumn("loss", F.array_join(under_mask(F.col("formatted"), F.col("loss_mask")), ""))
    loss = F.col("loss")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (
  SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ':', '\:')
         || ': ' || replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>') || '</turn>' || chr(10) AS out
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(out)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
