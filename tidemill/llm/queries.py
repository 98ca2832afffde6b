"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.common import table


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.fingerprints import compare_with_next

    return compare_with_next(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), bpe_path())


def op4_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.preferences import stale_reply_preferences

    return stale_reply_preferences(table(spark, sf_dir, "conversations"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.embeddings import similar

    return similar(table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), measure=True)


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.langid import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.neardup import classes

    return classes(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from tidemill.llm.embeddings import LINKS_SQL
    from tidemill.llm.mixing import MIX_SQL
    from tidemill.llm.preferences import PREFERENCE_SQL
    from tidemill.llm.substrings import REPEATS_SQL
    from tidemill.llm.warc import REVISIT_SQL

    return {"op4_preference_formatting": PREFERENCE_SQL, "op5_embedding_near_dedup": LINKS_SQL, "op7_warc_revisits": REVISIT_SQL, "op6_substring_dedup": REPEATS_SQL, "op10_source_mixing": MIX_SQL}
