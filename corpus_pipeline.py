"""From raw documents to shuffled training shards, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor
kept, and returns a DataFrame; `run` writes each result as Parquet in the
shared folder and reads it again as the next stage's docs. All but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dxspark.llm.common import stored, table
from dxspark.llm.decontaminate import decontaminate
from dxspark.llm.mixing import mix
from dxspark.llm.quality import quality
from dxspark.llm.shard import shard_rows
from dxspark.llm.simhash import first_of_classes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the limits are taken out of the rest."""
    kept = quality(docs.select(*COLUMNS)).where("kept")
    changed = F.col("n_removed_lines") > 0
    return kept.select("doc_id", F.when(changed, F.col("clean_text")).otherwise(F.col("text")).alias("text"), "lang", "source",
                       F.when(changed, F.length("clean_text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays."""
    return first_of_classes(docs.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least one word in twenty inside a benchmark window go."""
    marked = decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return marked.where("NOT contaminated").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's budget takes it."""
    mixed = mix(docs.select(*COLUMNS))
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row to a place in one of 16 shards of equal counts."""
    return shard_rows(docs.select(*COLUMNS))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: XXH64 fingerprints, component search and the random shuffle are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
