"""Corpus pipeline: toxicity, near-dedup, substring dedup, mixing, packing.

Every stage but the last takes and returns the columns of ``documents``.  ``run`` writes each stage's rows to
the shared folder and reads them again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import mixing, near_dedup, packing, substring_dedup, toxicity
from cadenza.llm.common import WORD, read_table, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.drop_toxic(docs.select(*COLUMNS), read_table(spark, sf_dir, "labels"))


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """The documents, written with a number of their own (``rid``): equal rows stay rows, and no two share a number."""
    return stage(docs.select(*COLUMNS).withColumn("rid", F.monotonically_increasing_id()), name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, 0.8) the row with the smallest id stays, once; rows without id come last.

    Rows are told by a number of their own, so ids may be null or repeat: equal rows, and other texts under one id, are
    documents like all others.  Rows without words are linked with nothing and stay.
    """
    docs = _numbered(docs, "documents")
    groups = near_dedup.near_duplicates(docs, id_col="rid", size=5, percent=80).select(F.col("doc_id").alias("rid"), "component_id")
    named = groups.join(docs.select("rid", "doc_id"), "rid")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best"))
    return docs.join(first.select(F.col("best.rid").alias("rid")), "rid", "left_semi").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows of 35 words that occur again are cut from the texts; every row stays, whatever its id."""
    cut = substring_dedup.dedup_substrings(docs.select(*COLUMNS), with_text=True, carry=("lang", "source"))
    return cut.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy in the mix; the copy in service at the end of a source's share is cut to its words.

    Every row is served, also those with equal or null ids: they are dealt by a hash of all their columns, so reruns
    agree, and told by a number of their own.
    """
    docs = _numbered(docs, "documents").withColumn("order", F.xxhash64(*[x for c in COLUMNS for x in (F.col(c).isNull(), F.col(c))]))
    taken = mixing.mix(docs, sort=False, id_col="order", key_col="rid").where("taken > 0").select(F.col("key").alias("rid"), "size", "taken")
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), F.lit(1), F.col("taken").cast("int")), " ")
    mixed = docs.join(taken, "rid").withColumn("text", F.when(F.col("taken") < F.col("size"), head).otherwise(F.col("text")))
    return mixed.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]
#: Model scores, links and tokens are beyond SQL: tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
