"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.

All stages but the last return the columns of documents, whatever they are besides doc_id and text;
the last returns the packed pieces. Each works on all its predecessor kept:

* toxicity drops the documents that are predicted toxic,
* exact_dedup keeps, of texts that are equal up to white space, the one with the least doc_id,
* jaccard_join keeps one document of each group of near-duplicates,
* pii replaces personal data in the texts by its kind, and brings n_chars in line,
* packing cuts the documents into pieces and packs these into sequences.

Defined results, in every stage: null texts count as empty and null ids are ids like any other; empty
tables pass through; long texts are taken whole. Repeated rows and rows that share an id are rows each:
toxicity and pii treat them alike, packing packs each, exact_dedup keeps one of equal texts and
jaccard_join one of a group (of equal ids the row that was read first). Columns besides doc_id and text
pass through untouched whatever their names, n_chars excepted, which pii brings in line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._util import Scratch, table
from tessera.llm.exact_dedup import duplicates
from tessera.llm.jaccard_join import similarity_join
from tessera.llm.packing import pack
from tessera.llm.pii import find_pii
from tessera.llm.toxicity import score_toxicity


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """row and doc (the whole row as a struct, in which no name can clash), written: a number that was
    made anew in a later job could be another row's, as splits follow the executors at hand."""
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("doc")
    return Scratch(spark, "stage").write(docs.select(F.monotonically_increasing_id().alias("row"), whole))


def _keep_rows(numbered: DataFrame, kept: DataFrame) -> DataFrame:
    """The whole rows whose numbers are in ``kept``."""
    return numbered.join(kept.select("row"), "row", "left_semi").select("doc.*")


def _texts(numbered: DataFrame) -> DataFrame:
    return numbered.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))


def _with_whole(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row as a struct, in which no name can clash."""
    return docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = score_toxicity(_with_whole(docs), table(spark, sf_dir, "labels"), keep=("_doc",))
    return scored.where("predicted = 0").select("_doc.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    numbered = _numbered(spark, docs)
    found = duplicates(_texts(numbered), row_col="row")
    return _keep_rows(numbered, found.where("kept").select(F.col("row_no").alias("row")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    numbered = _numbered(spark, docs)
    return _keep_rows(numbered, similarity_join(_texts(numbered), row_col="row").where("kept"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = find_pii(_with_whole(docs), redacted=True, keep=("_doc",))
    own = {"text": F.col("redacted"), "n_chars": F.char_length("redacted").cast("long")}
    return found.select(*[(own[c] if c in own else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("pii", pii),
    ("packing", packing),
]

#: The learnt stages can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(docs)
            scratch.keep_only(docs)
    return docs
