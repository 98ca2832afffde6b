"""A corpus pipeline of five stages, each of which calls one operator of ``tidemill.llm`` on the documents its predecessor kept.

language ID (documents without a language or of too low a likeness go), MinHash near-dedup (the smallest id of each class stays), substring
dedup (repeated passages go; a document of which nothing is left goes), mixing (a document stands there as
often as the mix takes it; one that is in service at the end is taken whole if at least half of it was served, else not), best-fit packing (one row for each piece).

All but the last return the columns of documents. Null and empty texts go in the first stage; extra columns are
dropped; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import langid, mixing, neardup, packing, substrings
from tidemill.llm.common import crc_bucket, stage
from tidemill.llm.queries import bpe_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: (characters, cosine with the best language profile below which a text of so many isn't taken for a language at all): the smaller of
#: the 0.99 quantile of random letters and the 0.01 quantile of held-out documents cut to that length (sf0.1; figures in the README).
LEAST_LIKENESS = ((0, 0.0), (8, 0.033), (16, 0.082), (32, 0.113), (64, 0.114), (128, 0.122), (256, 0.125), (512, 0.136), (1024, 0.146), (4096, 0.179))


def _shaped(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _shaped(docs)
    model = langid.learn(docs.filter(F.coalesce(crc_bucket("doc_id", 5) != 0, F.lit(False))))
    found = langid.predict(docs, model)
    least = F.lit(0.0)
    for n, cosine in LEAST_LIKENESS:
        least = F.when(F.length("text") >= n, cosine).otherwise(least)
    return _shaped(found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= least)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _shaped(docs)
    gone = neardup.classes(docs).filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(_shaped(docs)).filter("text <> ''")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_shaped(docs), carry_text=True).filter("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size"))
    rest = F.col("taken") - whole * F.col("size")
    texts = F.array_repeat("row.text", (whole + F.when(2 * rest >= F.col("size"), 1).otherwise(0)).cast("int"))  # whichever is nearer the target
    return mixed.select("row", F.explode(texts).alias("text")).select("row.doc_id", "text", "row.lang", "row.source", F.length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(_shaped(docs), bpe_path())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]
#: Hyperdimensional profiles and token ids can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
