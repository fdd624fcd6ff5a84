"""Human review as events: actions, manual links, the audit trail, latest decisions and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C

ACTIONS = {"CONFIRM": "CONFIRMED", "REJECT": "REJECTED", "UNLINK": "REJECTED"}


def act(results: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results with the statuses that actions (batch_id, id, action, user_id, comments, ts) give them, and the audit rows.

    The last action on a result counts; unknown actions change nothing and leave no audit row. Audit rows
    carry the status before the run of actions.
    """
    status = F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv))
    known = actions.withColumn("new_status", status[F.upper("action")]).filter("new_status IS NOT NULL")
    last = known.groupBy("batch_id", "id").agg(F.max_by("new_status", F.struct("ts", "new_status")).alias("new_status"))
    out = results.join(last, ["batch_id", "id"], "left").withColumn("match_status", F.coalesce("new_status", "match_status")).drop("new_status")
    prior = results.select("batch_id", "id", "source_id", "dest_id", F.col("match_status").alias("previous_status"), "confidence_score")
    audit = known.join(prior, ["batch_id", "id"]).select("batch_id", "source_id", "dest_id", "user_id", F.upper("action").alias("action"), "previous_status", "new_status", "confidence_score", F.col("comments").alias("review_comments"), "ts")
    return out, audit


def manual_links(links: DataFrame, sources: DataFrame, destinations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confirmed results and OVERRIDE audit rows for links (batch_id, source_id, dest_id, score, user_id, comments, ts) whose records both exist."""
    there = links.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(destinations.select(F.col("id").alias("dest_id")), "dest_id", "left_semi")
    rows = there.select(
        "batch_id", F.concat_ws("-", "batch_id", "source_id", "dest_id", F.lit("manual")).alias("id"), "source_id", "dest_id", F.col("score").alias("confidence_score"),
        F.lit("CONFIRMED").alias("match_status"), F.lit(0).alias("rank"), F.lit("Manually linked by reviewer").alias("decision_note"), F.col("ts").alias("created_at"),
    )
    audit = there.select("batch_id", "source_id", "dest_id", "user_id", F.lit("OVERRIDE").alias("action"), F.lit("NO_MATCH").alias("previous_status"), F.lit("CONFIRMED").alias("new_status"), F.col("score").alias("confidence_score"), F.col("comments").alias("review_comments"), "ts")
    return rows, audit


def audit_page(audit: DataFrame, batch_id: str | None = None, user_id: str | None = None, action: str | None = None) -> DataFrame:
    """Audit rows of a batch, user or action, newest first, then by larger identifier."""
    for name, value in (("batch_id", batch_id), ("user_id", user_id), ("action", action)):
        if value:
            audit = audit.filter(F.col(name) == value)
    return audit.orderBy(F.desc("ts"), F.desc("id"))


#: The header of the audit file, by column. Fixed values.
AUDIT_EXPORT = {
    "id": "Audit Log ID", "batch_id": "Batch ID", "ts": "Timestamp", "user_id": "Reviewer User ID", "action": "Action", "previous_status": "Previous Status",
    "new_status": "New Status", "confidence_score": "Confidence Score", "review_comments": "Reviewer Comments",
}


def export_audit(audit: DataFrame, batch_id: str | None = None) -> DataFrame:
    """The rows of the audit file under its header, newest first: times in UTC to the second, four decimals, empty cells for what is missing."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in AUDIT_EXPORT}
    text["ts"] = F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    text["confidence_score"] = C.fixed(F.coalesce("confidence_score", F.lit(0.0)), 4)
    return audit_page(audit, batch_id).select(*(text[c].alias(title) for c, title in AUDIT_EXPORT.items()))


def labels(audit: DataFrame) -> DataFrame:
    """Audit rows with is_match: confirmed 1, rejected 0, an override by its new status; others are left out."""
    new = F.col("new_status")
    by_status = F.when(new == "CONFIRMED", 1).when(new == "REJECTED", 0)
    label = F.when(F.col("action") == "CONFIRM", 1).when(F.col("action") == "REJECT", 0).when(F.col("action") == "OVERRIDE", by_status)
    return audit.withColumn("is_match", label).filter("is_match IS NOT NULL")


def latest(events: DataFrame, keys: list[str], ts: str = "ts", tie: str = "id") -> DataFrame:
    """The last event of each key; of simultaneous ones the first by ``tie``. One aggregate, so no key gathers in a task."""
    rest = [c for c in events.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(ts), -F.col(tie))).alias("best")
    return events.groupBy(*keys).agg(best).select(*keys, "best.*")


def observations(audit: DataFrame) -> DataFrame:
    """Labelled scores: the latest usable decision of each batch, source and destination."""
    return latest(labels(audit), ["batch_id", "source_id", "dest_id"]).withColumnRenamed("confidence_score", "score")


def label_statistics(observed: DataFrame) -> DataFrame:
    return observed.groupBy("previous_status").agg(F.count("*").alias("n"), F.sum("is_match").alias("matches"))


def holdout(observed: DataFrame, keys: tuple[str, ...] = ("batch_id", "source_id", "dest_id")) -> DataFrame:
    """With held_out: every fifth observation in key order. Observations are human decisions, few enough for one sort."""
    place = F.row_number().over(Window.orderBy(*keys))
    return observed.withColumn("held_out", F.pmod(place - 1, F.lit(5)) == 4)
