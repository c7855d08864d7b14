"""An extension: catalog records that arrive as files, upserted batch by batch into versioned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import SCHEMA, upsert


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    schema = ", ".join(f"{c} {t}" for c, t in SCHEMA.items())
    return spark.read.schema(schema).parquet(f"{root}/v={version}") if version >= 0 else spark.createDataFrame([], schema)


def follow(spark: SparkSession, feed: str, schema: str, root: str, checkpoint: str, supplied: Sequence[str]) -> StreamingQuery:
    """Each micro-batch k of JSON files under feed makes root/v=k from v=k-1. A batch that runs again writes the same version."""

    def step(batch: DataFrame, k: int) -> None:
        records = batch.withColumn("_order", F.monotonically_increasing_id())
        upsert(read_version(batch.sparkSession, root, k - 1), records, supplied, order="_order").write.mode("overwrite").parquet(f"{root}/v={k}")

    return spark.readStream.schema(schema).json(feed).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
