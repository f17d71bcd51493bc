r"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests. DataFrame operations only.

A text's paragraphs are its parts between line feeds and sentence ends; one of more than ``LONG`` words
is parted further after words whose hash meets a condition (one word in ``EVERY``, about), so that an
edit leaves the parts elsewhere as they are. A paragraph of up to ``LONG`` words, or without white space,
is whole: any edit of it makes it another. So a text of one such paragraph shares nothing with an edited
one, and neither does a paragraph little over ``LONG`` words with what an edit makes shorter. Each distinct paragraph's
64-bit digest goes into one cell of each of three tables; a cell holds a signed count, the exclusive-or
of its digests and of their check values. Sketches of two versions are subtracted cell by cell: what
both hold vanishes. A cell left with a single digest gives it away; taking that digest out of its other
cells may free more, and so on (peeling), until all differing digests are known.

The fingerprint has ``3 * WIDTH`` cells, whatever the text's length, so it recovers a dozen or so
differing paragraphs. When peeling gets stuck, the digests are dealt by their own bits to blocks of a
few paragraphs each, and every block is sketched, subtracted and peeled alone: a sketch that is larger
as a whole, at a cost linear in the length. A block that is still stuck is sketched wider (``RETRIES``),
and one that no width frees is compared by its digests.

The likeness of two texts is (a + b - d) / (a + b + d) for a and b paragraphs of which d differ: the
share of common paragraphs.

Scale: documents are cut into ranges of about equal size, by their ids and, so that an id that many rows
share (or none has) is split too, by the beginnings of their texts; a row's range is found by binary
search. A text travels once, with its digests and sketch, to its range; the next document of a range's last one comes along as a guest
row, one for each range. Dealing to blocks and gathering them happens inside the range's task, with no
further exchange.

Defined results: null texts are empty; an empty text has no paragraphs, and two of them are alike (1).
Documents are ordered by descending id, rows of one id by their text, null ids last; a single document
is its own next. Ids may be of any type that has an order. Rows that are equal in their id and the first
``BEGINNING`` characters of their text fall into one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..order import Ranges, desc
from ._util import shuffle_partitions, table, text_of

#: Paragraphs end at line feeds, and at sentence ends before white space.
PARAGRAPH = r"(?<=[.!?])[\x20\x09-\x0D]+|\n+"
#: Where words begin; words of a paragraph that stays whole, and of a part of a longer one, about (a power of two).
WORD = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"
LONG, EVERY = 32, 16
#: Characters of a text that tell rows of one id apart when they are dealt to ranges.
BEGINNING = 64
TABLES, WIDTH, ROUNDS = 3, 8, 12
#: Widths tried on a block that is stuck; paragraphs of a version in a block, about.
RETRIES, BLOCK = (8, 32, 128), 4


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once: an expression that is written twice runs twice."""
    return F.transform(F.array(value), then)[0]


def _parts(paragraph: Column) -> Column:
    """A paragraph, in parts if it is long. No paragraph holds a line feed."""

    def cut(words: Column) -> Column:
        ends = lambda w: F.xxhash64(w, F.lit(11)).bitwiseAND(F.lit(EVERY - 1)) == 0
        marked = F.transform(words, lambda w: F.when(ends(w), F.concat(w, F.lit("\n"))).otherwise(w))
        return F.when(F.size(words) > LONG, F.split(F.array_join(marked, ""), "\n", -1)).otherwise(F.array(paragraph))

    # more than LONG words take more than 2 * LONG characters
    return F.when(F.char_length(paragraph) <= 2 * LONG, F.array(paragraph)).otherwise(_let(F.split(paragraph, WORD, -1), cut))


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs."""
    parts = F.filter(F.flatten(F.transform(F.split(text, PARAGRAPH, -1), _parts)), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(7)).bitwiseAND(F.lit(0xFFFFFFFF))


def _placed(key: Column, n: Column | None, width: int) -> Column:
    """A digest with its place in each table: bits of the digest itself (``width`` is a power of two)."""
    places = [
        F.shiftrightunsigned(key, 20 * t).bitwiseAND(F.lit(width - 1)).cast("int").alias(f"at{t}") for t in range(TABLES)
    ]
    return F.struct(key.alias("key"), _check(key).alias("check"), *([n.alias("n")] if n is not None else []), *places)


def _cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), key.cast("long").alias("key"), check.cast("long").alias("check"))


def _tables(make) -> Column:
    return F.struct(*[make(t).alias(f"t{t}") for t in range(TABLES)])


def sketch(keys: Column, width: int = WIDTH) -> Column:
    """The tables of an array of digests, ``width`` cells each."""

    def build(all_: Column) -> Column:
        def one(t: int) -> Column:
            return F.transform(
                F.sequence(F.lit(0), F.lit(width - 1)),
                lambda j: F.aggregate(
                    F.filter(all_, lambda p: p[f"at{t}"] == j),
                    _cell(F.lit(0), F.lit(0), F.lit(0)),
                    lambda a, p: _cell(a["n"] + 1, a["key"].bitwiseXOR(p["key"]), a["check"].bitwiseXOR(p["check"])),
                ),
            )

        return _tables(one)

    return _let(F.transform(keys, lambda k: _placed(k, None, width)), build)


def subtract(a: Column, b: Column) -> Column:
    minus = lambda x, y: _cell(x["n"] - y["n"], x["key"].bitwiseXOR(y["key"]), x["check"].bitwiseXOR(y["check"]))
    both = F.struct(a.alias("a"), b.alias("b"))
    return _let(both, lambda v: _tables(lambda t: F.zip_with(v["a"][f"t{t}"], v["b"][f"t{t}"], minus)))


def _single(c: Column) -> Column:
    return (F.abs(c["n"]) == 1) & (c["check"] == _check(c["key"]))


def _left(c: Column) -> Column:
    return (c["n"] != 0) | (c["key"] != 0) | (c["check"] != 0)


def peel(tables: Column, width: int = WIDTH, rounds: int = ROUNDS) -> Column:
    """Differing digests as an array of (key, n): n is 1 for the first version's, -1 for the second's.
    Null when cells are left that give nothing away."""
    names = [f"t{t}" for t in range(TABLES)]

    def one_round(state: Column, _: Column) -> Column:
        seen = [F.filter(state[t], _single) for t in names]
        pure = F.array_distinct(
            F.transform(F.concat(*seen), lambda c: F.struct(c["key"].alias("key"), c["n"].alias("n")))
        )

        def go_on(all_: Column) -> Column:
            def without(t: int) -> Column:
                return F.transform(
                    state[f"t{t}"],
                    lambda c, j: F.when(
                        F.exists(all_, lambda p: p[f"at{t}"] == j),
                        F.aggregate(
                            F.filter(all_, lambda p: p[f"at{t}"] == j),
                            c,
                            lambda a, p: _cell(a["n"] - p["n"], a["key"].bitwiseXOR(p["key"]), a["check"].bitwiseXOR(p["check"])),
                        ),
                    ).otherwise(c),
                )

            found = F.transform(all_, lambda p: F.struct(p["key"].alias("key"), p["n"].alias("n")))
            after = [without(t).alias(f"t{t}") for t in range(TABLES)]
            return F.when(
                F.size(all_) > 0,
                F.struct(*after, F.concat(state["found"], found).alias("found"), F.lit(True).alias("going")),
            ).otherwise(F.struct(*[state[t].alias(t) for t in names], state["found"].alias("found"), F.lit(False).alias("going")))

        return F.when(state["going"], _let(F.transform(pure, lambda p: _placed(p["key"], p["n"], width)), go_on)).otherwise(state)

    found_type = "array<struct<key:bigint,n:int>>"
    start = lambda v: F.struct(
        *[v[t].alias(t) for t in names], F.array().cast(found_type).alias("found"), F.lit(True).alias("going")
    )

    def finish(state: Column) -> Column:
        some = F.lit(False)
        for t in names:
            some = some | F.exists(state[t], _left)
        return F.when(~some, state["found"])

    return _let(tables, lambda v: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start(v), one_round, finish))


def differing(a: Column, b: Column, widths: tuple[int, ...] = RETRIES) -> Column:
    """How many digests are in one array only: sketched, subtracted and peeled, wider when stuck."""
    tries = [F.array_size(peel(subtract(sketch(a, w), sketch(b, w)), w)) for w in widths]
    return F.coalesce(*tries, F.size(F.array_except(a, b)) + F.size(F.array_except(b, a)))


def likeness(a: Column, b: Column, d: Column) -> Column:
    total = (a + b).cast("double")
    return F.when(total == 0, F.lit(1.0)).otherwise((total - d) / (total + d))


def as_text(tables: Column) -> Column:
    return F.array_join(
        F.transform(
            _let(tables, lambda v: F.concat(*[v[f"t{t}"] for t in range(TABLES)])),
            lambda c: F.concat(c["n"].cast("string"), F.lit(":"), F.hex(c["key"]), F.lit(":"), F.hex(c["check"])),
        ),
        ";",
    )


def with_next(df: DataFrame) -> tuple[DataFrame, WindowSpec]:
    """(doc_id, text) and guest rows, with the range, and the window in which the next row is the document
    that follows by descending id. A range's last document is followed by a guest, the first of the next
    range; the last document of all by the first of all."""
    spark = df.sparkSession
    begins = F.substring("text", 1, BEGINNING)
    r = Ranges(df, [desc("doc_id"), desc(begins)], n=4 * shuffle_partitions(spark), ties=False)
    placed = r.df.withColumnRenamed(r.name, "range")
    # the first document of each range, by its id: one row for each range
    heads = placed.groupBy("range").agg(F.max("doc_id").alias("head")).collect()
    order = sorted(h["range"] for h in heads)
    guest_of = {k: order[i - 1] for i, k in enumerate(order)}  # the range before; the last one of the first
    kind = df.schema["doc_id"].dataType.simpleString()
    listed = [F.struct(F.lit(h["range"]).alias("range"), F.lit(h["head"]).cast(kind).alias("head"), F.lit(guest_of[h["range"]]).alias("guest_of")) for h in heads]
    pairs = spark.range(1).select(F.explode(F.array(*listed).cast(f"array<struct<range:int,head:{kind},guest_of:int>>")).alias("p")).select("p.*")
    first = Window.partitionBy("range").orderBy(F.desc("text"))
    guests = (
        placed.join(F.broadcast(pairs), "range").where(F.col("doc_id").eqNullSafe(F.col("head")))
        .withColumn("k", F.row_number().over(first)).where("k = 1")
        .select("doc_id", "text", F.col("guest_of").alias("range"))
    )
    rows = placed.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    return rows, Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("text"))


def compare_versions(rows: DataFrame, pairs: dict[str, tuple[str, str]], keep: list[str]) -> DataFrame:
    """The kept columns and a likeness for each named pair of digest arrays, whose sketches are in columns
    named ``<array>_sketch``. ``rows`` is partitioned by ``range``, and so is all that follows."""
    sides = list(dict.fromkeys(c for pair in pairs.values() for c in pair))
    firsts = {n: F.array_size(peel(subtract(F.col(f"{a}_sketch"), F.col(f"{b}_sketch")))) for n, (a, b) in pairs.items()}
    rows = rows.select(
        "range", *keep, *sides, F.monotonically_increasing_id().alias("_row"),
        *[d.alias(f"_d_{n}") for n, d in firsts.items()],
    )
    blocks = F.ceil(F.greatest(*[F.size(s) for s in sides], F.lit(1)) / F.lit(BLOCK)).cast("int")
    stuck = F.lit(False)
    for n in pairs:
        stuck = stuck | F.col(f"_d_{n}").isNull()
    own = F.struct(*keep, *[F.size(s).alias(f"_size_{s}") for s in sides], *[F.col(f"_d_{n}") for n in pairs])
    block = lambda k: F.pmod(F.xxhash64(k, F.lit(99)), F.col("_blocks")).cast("int")

    def of_side(i: int, s: str) -> Column:
        keys = F.transform(F.col(s), lambda k: F.struct(F.lit(i).alias("side"), k.alias("key"), block(k).alias("block")))
        return F.when(stuck, keys).otherwise(F.array().cast("array<struct<side:int,key:bigint,block:int>>"))

    marker = F.struct(F.lit(-1).alias("side"), F.lit(0).cast("long").alias("key"), F.lit(0).alias("block"))
    dealt = F.concat(F.array(marker), *[of_side(i, s) for i, s in enumerate(sides)])
    spread = rows.withColumn("_blocks", blocks).select("range", "_row", own.alias("_own"), F.explode(dealt).alias("e"))
    spread = spread.select(
        "range", "_row", "e.block", "e.side", "e.key", F.when(F.col("e.side") < 0, F.col("_own")).alias("_own")
    )
    by_block = spread.groupBy("range", "_row", "block").agg(
        F.first("_own", ignorenulls=True).alias("_own"),
        *[F.collect_list(F.when(F.col("side") == i, F.col("key"))).alias(s) for i, s in enumerate(sides)],
    )
    by_block = by_block.select(
        "range", "_row", "_own", *[differing(F.col(a), F.col(b)).alias(f"_b_{n}") for n, (a, b) in pairs.items()]
    )
    whole = by_block.groupBy("range", "_row").agg(
        F.first("_own", ignorenulls=True).alias("_own"), *[F.sum(f"_b_{n}").alias(f"_b_{n}") for n in pairs]
    )
    return whole.select(
        *[F.col(f"_own.{k}") for k in keep],
        *[
            likeness(F.col(f"_own._size_{a}"), F.col(f"_own._size_{b}"), F.coalesce(F.col(f"_own._d_{n}"), F.col(f"_b_{n}"))).alias(n)
            for n, (a, b) in pairs.items()
        ],
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows, following = with_next(docs.select(docs["doc_id"], text_of(docs).alias("text")))
    # digests and the sketch of a text are made once, and travel with it
    rows = rows.withColumn("own", digests(F.col("text"))).withColumn("own_sketch", sketch(F.col("own")))
    rows = rows.select("*", *[F.lead(c).over(following).alias(c.replace("own", "next")) for c in ("own", "own_sketch")], F.lead("text").over(following).alias("next_text")).where("not guest")
    n = F.char_length("text")
    half = F.floor(n / F.lit(2)).cast("int")
    rows = rows.withColumn(
        "edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    )
    rows = rows.select(
        "range", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "own", "next", "own_sketch", "next_sketch", digests(F.col("edited")).alias("new"),
    ).withColumn("new_sketch", sketch(F.col("new")))
    rows = rows.withColumn("fingerprint", as_text(F.col("own_sketch"))).withColumn("edited_fingerprint", as_text(F.col("new_sketch")))
    return compare_versions(
        rows,
        {"near_edited": ("own", "new"), "near_next": ("own", "next")},
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"],
    )
