"""The corpus pipeline: from raw documents to packed training sequences.

Each stage is a function of (spark, docs, folder of the tables) and works on what the
stage before it kept. All but the last return the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from usagelens.llm import mixing, near, packing, pii, quality
from usagelens.llm.registry import vocabulary
from usagelens.llm.tables import table
from usagelens.session import written

#: Documents with a lower quality score go.
LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects; it learns from all labels."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    score = quality.score_column(quality.fit(docs, labels))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.where(score(text) >= LEAST_QUALITY)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of equal and similar texts."""
    return near.representatives(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents in the order that interleaves sources by their target weights."""
    return mixing.in_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048, which are numbered along the mixture.

    Files that are read again have no order, so it is derived anew from ids and sources.
    """
    return packing.pack(mixing.in_order(docs), vocabulary())


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL: four stages learn, sample, extract or tokenize; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
