"""Queries over stored results: hydration, filters, pages, counters, summaries, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import columns as C

#: Fields that a page can be sorted by.
SORTABLE = ("confidence_score", "name_score", "date_score", "match_status", "created_at", "source_name", "dest_name")
#: Columns of the exported results, in order.
EXPORT = ("batch_id", "source_id", "reference_id", "source_name", "source_date", "dest_id", "customer_id", "dest_name", "dest_date", "confidence_score", "match_status", "reasons", "decision_note")


@dataclass(frozen=True)
class ResultsQuery:
    """A page request; values out of range are brought into it."""

    batch_id: str | None = None
    status: str = ""
    search: str = ""
    rank1_only: bool = False
    sort: str = "created_at"
    direction: str = "asc"
    page: int = 1
    limit: int = 20

    def normalized(self) -> ResultsQuery:
        limit = 20 if self.limit <= 0 else min(self.limit, 200)
        sort = self.sort if self.sort in SORTABLE else "created_at"
        direction = "desc" if self.direction.lower() == "desc" else "asc"
        return ResultsQuery(self.batch_id, self.status, self.search, self.rank1_only, sort, direction, min(max(self.page, 1), 1_000_000), limit)


def hydrate(results: DataFrame, sources: DataFrame, destinations: DataFrame) -> DataFrame:
    """Results with the names, keys and dates of both records, where there are any."""
    left = sources.select(F.col("id").alias("source_id"), "reference_id", F.col("raw_name").alias("source_name"), F.col("transaction_date").alias("source_date"))
    right = destinations.select(F.col("id").alias("dest_id"), "customer_id", F.col("raw_name").alias("dest_name"), F.col("transaction_date").alias("dest_date"))
    return results.join(left, "source_id", "left").join(right, "dest_id", "left")


def contains_any(columns: list[str], text: str) -> Column:
    """Case-insensitive literal substring in any of the columns; an empty text is in all."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower()))
    return hit if text else F.lit(True)


def matching(results: DataFrame, query: ResultsQuery) -> DataFrame:
    """Hydrated results of a batch by status, search text and rank; rank 0 counts as first."""
    out = results
    if query.batch_id is not None:
        out = out.filter(F.col("batch_id") == query.batch_id)
    if query.status not in ("", "ALL"):
        out = out.filter(F.col("match_status") == query.status)
    if query.search:
        out = out.filter(contains_any(["source_name", "dest_name", "reference_id", "customer_id"], query.search))
    if query.rank1_only:
        out = out.filter(F.col("rank") <= 1)
    return out


def page(results: DataFrame, query: ResultsQuery, key: str = "id") -> DataFrame:
    """One page in a total order: the sort field, text in lower case, then the key."""
    q = query.normalized()
    by = F.lower(q.sort) if q.sort in ("source_name", "dest_name") else F.col(q.sort)
    by = by.desc_nulls_last() if q.direction == "desc" else by.asc_nulls_first()
    return matching(results, q).orderBy(by, key).offset((q.page - 1) * q.limit).limit(q.limit)


def total_pages(rows: int, limit: int) -> int:
    return max(1, -(-rows // limit))


def counts_by_status(results: DataFrame, query: ResultsQuery = ResultsQuery()) -> DataFrame:
    return matching(results, query).groupBy("match_status").agg(F.count("*").alias("n"))


def outcome(results: DataFrame) -> DataFrame:
    """One row: auto (confirmed ones too), review, no_match, total and whether that is out of the ordinary."""
    count = lambda *s: F.count_if(F.col("match_status").isin(*s))
    out = results.agg(count("AUTO_MATCHED", "CONFIRMED").alias("auto_matched"), count("REVIEW_NEEDED").alias("review_needed"), count("NO_MATCH").alias("no_match"), F.count("*").alias("total"))
    odd = (F.col("auto_matched") / F.col("total") < 0.5) | (F.col("no_match") / F.col("total") > 0.3)
    return out.withColumn("anomaly", F.when(F.col("total") == 0, F.lit(False)).otherwise(odd))


def search_destinations(destinations: DataFrame, text: str, limit: int = 30) -> DataFrame:
    """The first destinations, in row order, whose name or key contains the text."""
    return destinations.filter(contains_any(["raw_name", "customer_id"], text)).orderBy("ordinal").limit(limit)


def batch_summaries(results: DataFrame) -> DataFrame:
    """Per batch: rows, distinct sources, auto, review, unmatched and the last creation time."""
    count = lambda s: F.count_if(F.col("match_status") == s)
    return results.groupBy("batch_id").agg(
        F.count("*").alias("results"), F.count_distinct("source_id").alias("sources"), count("AUTO_MATCHED").alias("auto_matched"),
        count("REVIEW_NEEDED").alias("review_needed"), count("NO_MATCH").alias("no_match"), F.max("created_at").alias("last_created"),
    )


def export_rows(hydrated: DataFrame) -> DataFrame:
    """The rows of the results file: four decimals, reasons joined, empty cells for what is missing."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in EXPORT if c not in ("confidence_score", "reasons")}
    text["confidence_score"] = C.fixed(F.coalesce("confidence_score", F.lit(0.0)), 4)
    text["reasons"] = F.array_join(F.coalesce("reasons", F.array().cast("array<string>")), "; ")
    return hydrated.select(*(text[c].alias(c) for c in EXPORT))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def write_results(results: DataFrame, path: str) -> None:
    """Replace the batches that ``results`` has in a table partitioned by batch; other batches stay."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


#: Jobs on a page unless another number is asked for, and at most.
JOBS_PAGE, JOBS_MOST = 20, 200


def jobs_page(jobs: DataFrame, limit: int = 0, offset: int = 0) -> DataFrame:
    """Past runs (batch_id, started_at, …), the latest first, then by larger identifier; numbers out of range are brought into it."""
    limit = JOBS_PAGE if limit <= 0 else min(limit, JOBS_MOST)
    return jobs.orderBy(F.desc("started_at"), F.desc("batch_id")).offset(max(offset, 0)).limit(limit)


def observed(results: DataFrame) -> tuple[DataFrame, Observation]:
    """``results`` as they are, and an observation with the counters of the action that next runs over them."""
    seen = Observation()
    count = lambda *s: F.count_if(F.col("match_status").isin(*s))
    counters = (F.count("*").alias("rows"), count("AUTO_MATCHED").alias("auto_matched"), count("REVIEW_NEEDED").alias("review_needed"), count("NO_MATCH").alias("no_match"))
    return results.observe(seen, *counters), seen
