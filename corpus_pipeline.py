"""The corpus pipeline: each stage reads what the one before it kept, as Parquet.

toxicity        documents that the network scores at or above its threshold go
near_duplicates one document of each near-duplicate group (shingles of five words) stays, that of the smallest doc_id; equal rows
                with an id are one document, rows without an id are linked with nothing and all stay
substrings      words of passages that an earlier document has are cut; untouched texts stay as they are
mixing          documents are repeated or dropped by Poisson counts, sources at their target weights
bpe             texts become ids, which are decoded to check the round trip

Each stage keeps the columns of its input, whatever their names: rows go through the operators whole, in one column. Null and
empty texts are kept and have no ids; an empty table gives an empty table. Other cases: see each operator.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm import bpe, mixing, neardup, substrings, toxicity
from tickforge.llm.store import materialize, table

ROW = "__cp_row"


def _carried(docs: DataFrame, *names: str) -> DataFrame:
    """The columns that an operator reads, and each row as a whole: no column of the operator's meets one of the table's."""
    return docs.select(*names, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(ROW))


def _unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    return rows.select(*(changed.get(c, F.col(ROW).getField(c)).alias(c) for c in docs.columns))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score(_carried(docs, "doc_id", "text"), table(spark, sf_dir, "labels"))
    return _unpacked(scored.filter("predicted = 0"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = neardup.near_duplicates(docs, size=5, similarity=0.8).filter("kept").select(F.col("doc_id").alias("__cp_id"), F.col("row_key").alias("__cp_of"))
    keyed = _carried(docs, "doc_id", "text").withColumn("__cp_key", F.xxhash64("doc_id", "text")).drop("text")
    same = (F.col("__cp_key") == F.col("__cp_of")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__cp_id"))
    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return _unpacked(keyed.join(kept, same, "left_semi").withColumn("__cp_own", own).dropDuplicates(["doc_id", "__cp_key", "__cp_own"]), docs)


def cut_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found, cut = substrings.dedup(_carried(docs, "doc_id", "text")), F.col("n_removed") > 0
    old = F.col(ROW)
    length = F.when(cut, F.length("kept_text").cast("long")).otherwise(old.getField("n_chars")) if "n_chars" in docs.columns else None
    return _unpacked(found, docs, text=F.when(cut, F.col("kept_text")).otherwise(F.col("text")), **({"n_chars": length} if length is not None else {}))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _unpacked(mixing.mix(_carried(docs, "doc_id", "source")), docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    codec = bpe.Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = codec.round_trip(docs.select("doc_id", "lang", "source", "text"))
    whole = F.coalesce("text", F.lit("")).cast("binary") == F.col("decoded")
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("round_trip"))


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("substrings", cut_substrings),
    ("mixing", mixed),
    ("bpe", tokenized),
]

#: A trained network decides the first stage, and SQL has no byte-level BPE; tests/llm/test_pipeline.py holds the stages and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
