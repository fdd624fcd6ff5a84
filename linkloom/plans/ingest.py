"""Ingest: both sides of a batch read through connectors, built into records and stored under the batch."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ColumnMapping
from ..operators import records, results
from ..sources import connectors

SIDES = ("sources", "destinations")


def ingest(spark: SparkSession, source: connectors.Connection, destination: connectors.Connection, path: str, mapping: ColumnMapping = ColumnMapping(), batch_id: str = "") -> dict:
    """Store a batch's records under ``path`` and tell how many there are and whether a side was cut at the cap.

    Rows are read in a total order where the cap cuts them. A batch of the same identifier is replaced, the
    others stay. An unknown connector type raises an error before anything is read.
    """
    for c in (source, destination):
        if c.type.upper() not in connectors.KINDS:
            raise ValueError(f"unknown connector type {c.type!r}")
    batch_id = batch_id or f"batch-{time.time_ns()}"
    out = {"batch_id": batch_id, "column_mapping": mapping}
    built = {}
    for side, c, build in zip(SIDES, (source, destination), (records.sources, records.destinations), strict=True):
        rows = connectors.read(spark, c)
        explicit, key = c.options.get("order_by", ""), connectors.primary_key(spark, c)
        order = connectors.total_order(rows, explicit, key) if rows.columns else None
        rows, out[f"{side}_truncated"] = connectors.capped(rows, order=order)
        built[side] = build(rows, mapping).withColumn("batch_id", F.lit(batch_id))
    for side, rows in built.items():
        results.write_results(rows, f"{path}/{side}")
        out[f"{side}_count"] = spark.read.parquet(f"{path}/{side}").filter(F.col("batch_id") == batch_id).count()
    out["truncated"] = any(out[f"{side}_truncated"] for side in SIDES)
    if out["truncated"]:
        out["warning"] = f"ingestion stopped at the cap of {connectors.max_ingest()} rows and more remain; the batch is incomplete"
    return out


def dataset(spark: SparkSession, path: str, batch_id: str) -> tuple[DataFrame, DataFrame]:
    """Source and destination records of a stored batch."""
    left, right = (spark.read.parquet(f"{path}/{side}").filter(F.col("batch_id") == batch_id).drop("batch_id") for side in SIDES)
    return left, right
