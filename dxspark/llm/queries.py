"""The registered queries of this package, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dxspark.llm.decontaminate import op7_decontaminate
from dxspark.llm.katz import op2_katz
from dxspark.llm.langid import op6_language
from dxspark.llm.lines import op1_lines
from dxspark.llm.minhash import op12_minhash
from dxspark.llm.mixing import op10_mixing
from dxspark.llm.quality import op3_quality
from dxspark.llm.shard import op8_sharding
from dxspark.llm.simhash import op4_simhash
from dxspark.llm.spelling import op13_spelling
from dxspark.llm.toxicity import op5_toxicity
from dxspark.llm.urls import OP9_SQL, op9_urls
from dxspark.llm.whiten import op11_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lines": op1_lines,
    "op2_katz": op2_katz,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_language": op6_language,
    "op7_decontaminate": op7_decontaminate,
    "op8_sharding": op8_sharding,
    "op9_urls": op9_urls,
    "op10_mixing": op10_mixing,
    "op11_whitening": op11_whitening,
    "op12_minhash": op12_minhash,
    "op13_spelling": op13_spelling,
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline

ORACLES: dict[str, str] = {"op9_urls": OP9_SQL}
