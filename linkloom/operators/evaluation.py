"""Quality of a run against labelled pairs, and the profile of candidate sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..llm.common import stash


def quality(results: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: precision, recall, f1 of automatic matches, top-1 accuracy, rows per source, most links of a side.

    truth: source_id, dest_id of true pairs. Sources of truth that have no result count as missed.
    """
    results = stash(results.select("source_id", "dest_id", "match_status", "rank"), "results")  # five counts read it
    auto = results.filter("match_status = 'AUTO_MATCHED'").select("source_id", "dest_id")
    true = truth.select("source_id", "dest_id").distinct()
    right = lambda pairs: pairs.join(true, ["source_id", "dest_id"], "left_semi")
    firsts = results.filter("rank = 1").select("source_id", "dest_id")
    per = lambda side: auto.groupBy(side).agg(F.count("*").alias("n"))
    counted = {
        "tp": (right(auto), F.count("*")), "found": (auto, F.count("*")), "wanted": (true, F.count("*")), "first_hits": (right(firsts), F.count("*")),
        "rows": (results, F.count("*")), "sources": (results, F.count_distinct("source_id")),
        "most_per_source_id": (per("source_id"), F.coalesce(F.max("n"), F.lit(0))), "most_per_dest_id": (per("dest_id"), F.coalesce(F.max("n"), F.lit(0))),
    }
    rows = [df.agg(of.alias("value")).select(F.lit(name).alias("name"), "value") for name, (df, of) in counted.items()]
    one = reduce(DataFrame.unionByName, rows).agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in counted))
    p, r = F.try_divide("tp", "found"), F.try_divide("tp", "wanted")
    return one.select(p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"), F.try_divide("first_hits", "wanted").alias("top1"), F.try_divide("rows", "sources").alias("rows_per_source"), "most_per_source_id", "most_per_dest_id")


def candidate_profile(candidates: DataFrame) -> DataFrame:
    """One row: median, 95th percentile and maximum of the candidates per source, by index floor(n q)."""
    sizes = candidates.groupBy("source_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("of"))
    # positions from a running sum over distinct sizes, which the candidate limit bounds
    upto = F.sum("of").over(Window.orderBy("n"))
    total = F.sum("of").over(Window.partitionBy())
    sizes = sizes.withColumns({"upto": upto, "total": total})
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("total") * q), F.col("n")))
    return sizes.agg(at(0.5).alias("median"), at(0.95).alias("p95"), F.max("n").alias("max"))
