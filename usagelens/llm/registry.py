"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from usagelens.llm import (
    fingerprints,
    html,
    language,
    merkle,
    mixing,
    near,
    neighbours,
    packing,
    pii,
    quality,
    substrings,
    toxicity,
    vector_codes,
)
from usagelens.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    """The tokenizer's vocabulary file; it is installed, never copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_substrings(spark: SparkSession, sf: str) -> DataFrame:
    rows = substrings.deduplicated(table(spark, sf, "documents"))
    one = lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))
    return rows.select(
        "doc_id", F.concat_ws(",", F.transform("removed", one)).alias("removed"), "text"
    )


def op2_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near.classes(table(spark, sf, "documents")).select("doc_id", "class_id", "copies")


def op3_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "embeddings"))


def op4_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digests(pii.extracted(table(spark, sf, "documents")))


def op5_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    rows = fingerprints.fingerprinted(table(spark, sf, "documents"))
    return rows.withColumn("edited", F.sha2("edited", 256)).withColumnRenamed(
        "edited", "edited_sha256"
    )


def op6_html(spark: SparkSession, sf: str) -> DataFrame:
    rows = html.main_text(table(spark, sf, "pages"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    seen = labels.where(_fold(5) != 0).select("doc_id", F.col("quality").alias("label"))
    return _scores(quality.scored(docs, quality.fit(docs, seen)), "quality_score", _fold(5) == 0)


def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf, "documents"), vocabulary()))


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    seen = labels.where(_fold(4) != 2).select("doc_id", F.col("toxic").alias("label"))
    return _scores(toxicity.scored(docs, toxicity.fit(docs, seen)), "toxic_score", _fold(4) == 2)


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return mixing.mixed(docs).select(
        "doc_id",
        mixing.source_name().alias("source"),
        F.col("mix_block").alias("block"),
        F.col("mix_slot").alias("slot"),
        F.col("mix_position").alias("position"),
    )


def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = vector_codes.compressed(table(spark, sf, "embeddings"))
    return rows.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    rows = language.identified(docs, language.fit(docs.where(_fold(5) != 0)))
    return rows.select("doc_id", (_fold(5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op13_merkle(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.manifest(table(spark, sf, "documents"))


def _scores(rows: DataFrame, score: str, held_out: Column) -> DataFrame:
    return rows.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col(score).alias("score"),
        (F.col(score) >= 0.3).cast("int").alias("predicted"),
    )


def queries() -> dict[str, Query]:
    return {
        "op1_substrings": op1_substrings,
        "op2_near_duplicates": op2_near_duplicates,
        "op3_neighbours": op3_neighbours,
        "op4_pii": op4_pii,
        "op5_fingerprints": op5_fingerprints,
        "op6_html": op6_html,
        "op7_quality": op7_quality,
        "op8_packing": op8_packing,
        "op9_toxicity": op9_toxicity,
        "op10_mixing": op10_mixing,
        "op11_vector_codes": op11_vector_codes,
        "op12_language": op12_language,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op10_mixing": mixing.sql(),
        "op11_vector_codes": vector_codes.sql(),
        "op13_merkle": merkle.sql(),
    }
