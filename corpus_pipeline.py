"""A corpus pipeline: language, toxicity, near duplicates, packing. Each stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import jaccard_join, language_mixture, packing, toxicity
from inkveil.llm.common import fold, table, written


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{name}`") for name in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with letters, whatever share of them their main language has; their columns stay, whatever their names."""
    names, logp = language_mixture.fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    packed = docs.select(F.struct(*_columns(docs)).alias("__document"), "text")
    return language_mixture.predict(packed, names, logp).where("lang_pred <> 'und'").select("__document.*")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that score below one half. Equal ids have one score each; a document goes if one of its rows does."""
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    toxic = written(scored.where("predicted = 1").select(F.col("doc_id").alias("__toxic")).distinct(), "toxic")
    if toxic.count() <= toxicity.LABELS_BROADCAST:
        toxic = F.broadcast(toxic)  # whole documents need not be shuffled then
    return docs.join(toxic, docs["doc_id"].eqNullSafe(F.col("__toxic")), "left_anti")


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates, whatever their ids: the one with the smallest id, null ids last.

    Texts without words are duplicates only if their ids are equal as well.
    """
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    keyed = rows.select(F.col("__row").alias("doc_id"), "text")
    groups = jaccard_join.near_duplicates(keyed).withColumnRenamed("doc_id", "__row")
    alike = groups.join(rows.select("__row", "doc_id", "text"), "__row").select(
        "__row", "doc_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component"),
        F.when(F.col("n_shingles") == 0, F.struct("doc_id", "text")).alias("blank"),
    )
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))["__row"]
    kept = alike.groupBy("component", "blank").agg(first.alias("__row")).select("__row")
    return rows.join(kept, "__row", "left_semi").select(*_columns(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes in sequences of the permitted lengths."""
    return packing.best_fit(docs.select("doc_id", packing.word_count().alias("n_tokens")))


STAGES = [("language", language), ("toxicity", not_toxic), ("near duplicates", deduplicated), ("packing", packed)]

#: Trained models and best-fit packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
