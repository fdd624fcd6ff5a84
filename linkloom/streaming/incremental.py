"""Incremental matching: new source rows against standing destinations, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import MatchConfig
from ..operators import decision
from ..plans import engine


def run_stream(stream: DataFrame, destinations: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, config: MatchConfig = MatchConfig(), **trigger) -> StreamingQuery:
    """Match every micro-batch of source rows and hand its results, with the batch's number, to ``sink``.

    One-to-one assignment holds within a micro-batch; ``settled`` makes it hold across those that were
    stored. The sink should replace what it has of a batch's number, as a failed batch is run again.
    """

    def each(rows: DataFrame, number: int) -> None:
        run = engine.match(rows, destinations, config, batch_id=f"stream-{number}")
        try:
            sink(run.results, number)
        finally:
            run.release()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def settled(results: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Stored results of many micro-batches with one source per destination: the best claim over all of them wins.

    Rows without a destination and reviewed rows stay as they are; a claim that lost before may win again.
    Source identifiers must be those of the whole stream, that is the rows must have come with an ordinal.
    """
    open_rows = results.filter("dest_id IS NOT NULL AND match_status IN ('AUTO_MATCHED', 'REVIEW_NEEDED') AND rank >= 1")
    rest = results.filter("NOT coalesce(dest_id IS NOT NULL AND match_status IN ('AUTO_MATCHED', 'REVIEW_NEEDED') AND rank >= 1, false)")
    again = decision.greedy(open_rows.withColumnRenamed("confidence_score", "total_score"), config)
    return again.withColumnRenamed("total_score", "confidence_score").select(*results.columns).unionByName(rest)
