"""The pN_ queries over the project's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import duplicate_pairs

    return duplicate_pairs(table(spark, sf_dir, "memes"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .names import name_pairs

    return name_pairs(table(spark, sf_dir, "meme_people"), table(spark, sf_dir, "memes"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import corrections

    return corrections(table(spark, sf_dir, "memes"), table(spark, sf_dir, "lang_codes")).drop("confidence")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbors import similar_pairs

    parts = [table(spark, sf_dir, f"embeddings_{a}").select(F.lit(a).alias("aspect"), "meme_id", "embedding", "created_at") for a in ("main", "context", "people")]
    return similar_pairs(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .unify import odd_fields

    return odd_fields(table(spark, sf_dir, "memes"))


def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one form of every document's text, and what was found in it; only texts that change."""
    from .unify import unify_columns

    texts = unify_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"])
    return texts.filter("text <> text_unified").select("doc_id", "text_unified", F.concat_ws(",", "text_findings").alias("findings"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .canonical import mapped_fields

    return mapped_fields(table(spark, sf_dir, "memes"), table(spark, sf_dir, "label_vocab")).drop("score")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .encode import encoded

    return encoded(table(spark, sf_dir, "documents"), "doc_id")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents, span by span, with their repeats."""
    from .mixing import mixture

    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share that each source reaches."""
    from .mixing import mixture

    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import text_quality

    return text_quality(table(spark, sf_dir, "documents")).filter("kind in ('list', 'table', 'junk')").select("doc_id", "kind")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p4_found, p5_found, p5_unified, p6_found, p7_ids, p8_mix, p8_shares, p9_found)}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return SQL
