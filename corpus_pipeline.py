"""The corpus pipeline: five stages over ``documents``, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nestwell.llm._common import Workspace, scratch
from nestwell.llm.decontaminate import drop_contaminated
from nestwell.llm.exact_dedup import drop_repeats
from nestwell.llm.near_dedup import drop_near
from nestwell.llm.packing import pack
from nestwell.llm.quality import drop_rejected


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_rejected(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeats(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near(docs, threshold=0.8, size=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=1024, end_id=0)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontamination", decontamination), ("packing", packing)]

#: Training a scorer and merging components aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        with scratch():
            docs = ws.stage(stage(spark, docs, sf_dir), name)
        if before is not None:
            ws.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
