"""Incremental stacking (an extension of ours): reports that land in a folder are upserted into content-addressed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.graph import merge_edges, merge_nodes


def upsert(spark: SparkSession, name: str, batch: DataFrame, path: str, version: int, edges: bool = False) -> None:
    """Merges a batch into the table at path/v<version-1> and writes path/v<version>. Ids hash their content, so a batch that is redone changes nothing."""
    before = f"{path}/v{version - 1}"
    whole = batch
    if version:
        whole = spark.read.schema(batch.schema).parquet(before).unionByName(batch)
    if edges:
        merged = merge_edges(whole)
    else:
        merged, conflicts = merge_nodes(name, whole)
        if not conflicts.isEmpty():
            raise ValueError(f"{name} rows of one id differ")
    merged.write.mode("overwrite").parquet(f"{path}/v{version}")


def stack_stream(spark: SparkSession, name: str, landing: str, schema: StructType, path: str, checkpoint: str):
    """A query that upserts every Parquet file landing in a folder; available rows only, then it stops."""
    def each(batch: DataFrame, number: int) -> None:
        upsert(batch.sparkSession, name, batch, path, number)

    return spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
