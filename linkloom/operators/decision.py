"""Decisions: ranks, margins, statuses, assignment strategies, unmatched sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import MatchConfig
from ..functions import columns as C

AUTO, REVIEW, NO_MATCH = "AUTO_MATCHED", "REVIEW_NEEDED", "NO_MATCH"


def ranked(scored: DataFrame, config: MatchConfig = MatchConfig(), within: tuple[str, ...] = ()) -> DataFrame:
    """Pairs at or above the review threshold with rank, runner_up and score_margin.

    within: columns that a source has one value of, by which rows may already be dealt.

    Ranks go by score, then by the destination's identifier as text. The margin is that of rank 1 to rank
    2, or its own score if it is alone; 0 for other ranks. Alternatives beyond the limit go afterwards.
    """
    order = Window.partitionBy(*within, "source_id").orderBy(F.desc("total_score"), "dest_id")
    out = scored.filter(F.col("total_score") >= config.review_threshold)
    out = out.withColumns({"rank": F.row_number().over(order), "_next": F.lead("total_score").over(order)})
    first = F.col("rank") == 1
    out = out.withColumn("runner_up", F.when(first, F.coalesce("_next", F.lit(0.0))).otherwise(0.0))
    out = out.withColumn("score_margin", F.when(first, F.col("total_score") - F.col("runner_up")).otherwise(0.0)).drop("_next")
    if config.max_alternatives_per_source > 0:
        out = out.filter(F.col("rank") <= config.max_alternatives_per_source)
    return out


def auto_matchable(score: Column, runner_up: Column, cross_script: Column, config: MatchConfig = MatchConfig()) -> tuple[Column, Column]:
    """Whether a score decides by itself, and the note that says why or why not."""
    bar = F.lit(config.auto_match_threshold)
    if config.cross_script_auto_threshold > 0:
        bar = F.when(cross_script, config.cross_script_auto_threshold).otherwise(bar)
    exact = (score >= config.exact_match_floor) & (runner_up < config.exact_match_floor)
    clear = (score >= bar) & (score - runner_up >= config.margin_threshold)
    note = (
        F.when(exact, F.concat(F.lit("Exact normalized match; best fuzzy alternative scored "), C.fixed(runner_up, 3)))
        .when(clear, "Top candidate meets auto-match threshold and margin threshold")
        .when(score >= bar, F.concat(F.lit("Ambiguous: runner-up within "), C.fixed(score - runner_up, 3), F.lit(" — needs review")))
        .otherwise("Below auto-match threshold — needs review")
    )
    return exact | clear, note


def decided(pairs: DataFrame, config: MatchConfig = MatchConfig(), calibrate=None) -> DataFrame:
    """Ranked pairs with calibrated_score, match_status and decision_note.

    Only rank 1 can match by itself, by calibrated scores if calibration is on; under ALL_CANDIDATES every
    rank is judged alone.
    """
    use = config.calibration_enabled and calibrate is not None
    pairs = pairs.withColumn("calibrated_score", calibrate(F.col("total_score")) if use else F.col("total_score"))
    runner = F.when(F.col("runner_up") > 0, calibrate(F.col("runner_up"))).otherwise(0.0) if use else F.col("runner_up")
    many = config.assignment_strategy == "ALL_CANDIDATES"
    auto, note = auto_matchable(F.col("calibrated_score"), F.lit(0.0) if many else runner, F.col("cross_script"), config)
    first = F.col("rank") == 1
    if many:
        status = F.when(auto, AUTO).otherwise(REVIEW)
        note = F.when(first, note).otherwise(F.format_string("%s (rank %d of several valid links)", note, F.col("rank")))
    else:
        status = F.when(first & auto, AUTO).otherwise(REVIEW)
        note = F.when(first, note).otherwise(F.format_string("Alternative candidate (rank %d) for review", F.col("rank")))
    return pairs.withColumns({"match_status": status, "decision_note": note})


def greedy(pairs: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """One source per destination: rank 1 is judged again on raw scores, and the best of a destination keeps it.

    As a source offers only its first rank, the best one by score, then source, is what a pass in score
    order would find. The winner's identifier and score come from an aggregate, so a destination that very
    many sources want is not gathered in one task.
    """
    auto, note = auto_matchable(F.col("total_score"), F.col("runner_up"), F.col("cross_script"), config)
    first = F.col("rank") == 1
    pairs = pairs.withColumns({
        "match_status": F.when(~first, F.col("match_status")).when(auto, AUTO).otherwise(REVIEW),
        "decision_note": F.when(first, note).otherwise(F.col("decision_note")),
    })
    claims = first & (F.col("match_status") == AUTO)
    best = pairs.filter(claims).groupBy("dest_id").agg(F.min(F.struct((-F.col("total_score")).alias("s"), "source_id")).alias("winner"))
    out = pairs.join(best, "dest_id", "left")
    lost = claims & (F.col("winner.source_id") != F.col("source_id"))
    told = F.concat(F.lit("Destination already assigned to "), F.col("winner.source_id"), F.lit(" at "), C.fixed(-F.col("winner.s"), 3))
    return out.withColumns({
        "match_status": F.when(lost, REVIEW).otherwise(F.col("match_status")),
        "decision_note": F.when(lost, told).otherwise(F.col("decision_note")),
    }).drop("winner")


def assigned(pairs: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Decided pairs after the configured strategy: one to one (also for an unknown one), first rank only, or all."""
    if config.assignment_strategy == "ALL_CANDIDATES":
        return pairs
    if config.assignment_strategy == "TOP_1":
        return pairs.filter("rank = 1")
    return greedy(pairs, config)


def unmatched(sources: DataFrame, candidates: DataFrame, kept: DataFrame) -> DataFrame:
    """source_id, match_status, decision_note for sources without a kept pair; the note says whether there were candidates.

    sources: id, candidates: source_id; or source_id and source_name, and source_name, where candidates are those of names.
    """
    by = "source_name" if "source_name" in candidates.columns else "source_id"
    sources = sources if "source_id" in sources.columns else sources.withColumnRenamed("id", "source_id")
    lost = sources.select(*dict.fromkeys(("source_id", by))).join(kept.select("source_id").distinct(), "source_id", "left_anti")
    had = candidates.select(by).distinct().withColumn("had", F.lit(True))
    note = F.when(F.col("had"), "All blocking candidates scored below review threshold").otherwise("No blocking candidates found")
    return lost.join(had, by, "left").select("source_id", F.lit(NO_MATCH).alias("match_status"), note.alias("decision_note"))
