"""Pair scores: the composite name and date score in one Arrow kernel, further fields in expressions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SecondaryField
from ..functions import columns as C
from ..functions import udfs
from ..functions.names import STORED, party_name, rebuilt
from ..functions.parties import composites
from ..functions.similarity import CAPPED_REASON, DATE_REASONS, FAR_REASON, NAME_REASONS, NO_DATE_REASON, Rules
from ..functions.together import name_scores
from ..llm.common import vacate

SCORES = ("total_score", "name_score", "date_score", "jw_score", "lev_score", "token_score", "trigram_score", "romanized_score")
#: Scored name pairs that a task remembers, as equal pairs recur.
MEMO_PAIRS = 100_000


def _scored(rules: Rules, kept: list[str], weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            if len(memo) >= MEMO_PAIRS:
                memo.clear()
            texts, weights, places = [], [], []
            for side in ("source", "dest"):
                at, distinct, first = _distinct(column[f"{side}_name"])
                places.append(at + len(texts))
                texts += distinct
                if weighted:  # tokens that the corpus doesn't have weigh 1
                    weights += [dict(x or ()) for x in column[f"{side}_weights"].take(first).to_pylist()]
            days = column["days"].to_pylist()
            keys = list(zip(*([texts[i] for i in x.tolist()] for x in places), days, strict=True))
            fresh = np.array(list({key: i for i, key in enumerate(keys) if key not in memo}.values()), np.int64)
            found = composites(list(map(party_name, texts)), *(x[fresh] for x in places), [days[i] for i in fresh.tolist()], rules, weights if weighted else None)
            memo.update(zip([keys[i] for i in fresh.tolist()], found, strict=True))
            values = list(zip(*(memo[key] for key in keys), strict=True)) if keys else [()] * 10
            arrays = [column[n] for n in kept] + [pa.array(v, pa.float64()) for v in values[:8]]
            arrays += [pa.array(values[8], pa.bool_()), pa.array(values[9], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, *SCORES, "cross_script", "reasons"])
        vacate()

    return run


def _distinct(names: pa.Array) -> tuple[np.ndarray, list[str], pa.Array]:
    """Of each name its number, the distinct names by number, and where each of them stands first."""
    raw = names.dictionary_encode("encode")
    at = raw.indices.to_numpy()
    return at, [x or "" for x in raw.dictionary.to_pylist()], pa.array(np.unique(at, return_index=True)[1])


def score_pairs(pairs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``pairs`` with the scores of source_name, dest_name and days (null: a date is missing), cross_script and reasons.

    source_weights and dest_weights, maps from token to weight, are used if they are there; without them
    the pair is scored as without a corpus. Those inputs are dropped, other columns are carried along.
    """
    inputs = {"source_name", "dest_name", "days", "source_weights", "dest_weights"}
    kept = [c for c in pairs.columns if c not in inputs]
    weighted = "source_weights" in pairs.columns
    kinds = dict(pairs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"{c} double" for c in SCORES), "cross_script boolean", "reasons array<string>"])
    return pairs.mapInArrow(_scored(rules, kept, weighted), schema)


NAMED = ("name", "jw_score", "lev_score", "token_score", "trigram_score", "romanized_score")


def _named(rules: Rules, kept: list[str], weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            names, weights, places = [], [], []
            for side in ("source", "dest"):
                at, texts, first = _distinct(column[f"{side}_name"])
                places.append(at + len(names))
                if f"{side}_cleaned" in column:
                    names += map(rebuilt, texts, *(column[f"{side}_{f}"].take(first).to_pylist() for f in STORED))
                else:
                    names += map(party_name, texts)
                if weighted:
                    weights += [dict(x or ()) for x in column[f"{side}_weights"].take(first).to_pylist()]
            found = name_scores(names, *places, rules, weights if weighted else None)
            arrays = [column[n] for n in kept] + [pa.array(v) for v in found[:8]] + [pa.array(found.said, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, *NAMED, "cross_script", "unrelated", "said"])
        vacate()

    return run


def score_names(pairs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``pairs`` of source_name and dest_name, of one party each, with what ``dated`` needs. Inputs are dropped as by ``score_pairs``.

    Names of a side whose ``STORED`` fields are there (source_cleaned and so on) are not normalised again.
    """
    inputs = {f"{side}_{f}" for side in ("source", "dest") for f in ("name", "weights", *STORED)}
    kept = [c for c in pairs.columns if c not in inputs]
    kinds = dict(pairs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"{c} double" for c in NAMED), "cross_script boolean", "unrelated boolean", "said int"])
    return pairs.mapInArrow(_named(rules, kept, "source_weights" in pairs.columns), schema)


def most_total(rules: Rules = Rules()) -> Column:
    """What the total of a name's score may come to, whatever the dates are."""
    return C.round4(F.greatest(F.col("name"), F.col("name") * rules.name_weight + F.lit(float(rules.date_weight))))


def dated(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Rows of ``score_names`` and days (null: a date is missing) with total_score, name_score and date_score, without days and name.

    What makes up the reasons is kept in said, see ``reasons``.
    """
    days, name = F.abs("days"), F.col("name")
    date = C.round4(F.exp(-0.05 * days))
    if rules.date_tolerance > 0:
        date = F.when(days > rules.date_tolerance, F.lit(0.0)).otherwise(date)
    rows = rows.withColumn("date_score", F.when(F.col("days").isNull(), F.lit(0.0)).otherwise(date))
    date = F.col("date_score")
    rows = rows.withColumn("total_score", F.when(F.col("days").isNull(), name).otherwise(name * F.lit(float(rules.name_weight)) + date * F.lit(float(rules.date_weight))))
    capped = F.col("unrelated") & (F.col("total_score") > rules.overlap_cap)
    told = F.when(F.col("days").isNull(), 0).when(date == 0, 1).otherwise(reduce(lambda w, x: w.when(date >= x[1][0], 2 + x[0]), enumerate(DATE_REASONS), F.when(F.lit(False), 0)).otherwise(2 + len(DATE_REASONS)))
    said = F.col("said") + F.shiftleft(capped.cast("int"), 16) + F.shiftleft(told, 20)
    return rows.withColumns({"said": said, "total_score": C.round4(F.when(capped, F.lit(float(rules.overlap_cap))).otherwise(F.col("total_score"))), "name_score": C.round4(name)}).drop("days", "name", "unrelated")


def reasons(said: Column) -> Column:
    """The reasons that ``dated`` keeps as a number."""
    names = [F.when(said.bitwiseAND(1 << i) != 0, F.lit(r)) for i, r in enumerate(NAME_REASONS)]
    told = F.shiftright(said, 20)
    date = reduce(lambda w, x: w.when(told == x[0], F.lit(x[1])), enumerate([NO_DATE_REASON, FAR_REASON, *(r for _, r in DATE_REASONS)]), F.when(F.lit(False), F.lit("")))
    return F.array_compact(F.array(*names, date, F.when(said.bitwiseAND(1 << 16) != 0, F.lit(CAPPED_REASON))))


def _field(s: SecondaryField, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Of one field: its score, its reason or null, whether it is a mandatory mismatch."""
    no = F.lit(False)
    reason = F.lit(None).cast("string")
    if s.match_type == "EXACT":
        same = C.equal_fold(a, b)
        hit = F.concat(F.lit(f"Exact match on {s.name} ("), a, F.lit(" == "), b, F.lit(")"))
        miss = F.concat(F.lit(f"Mandatory mismatch on {s.name} ("), a, F.lit(" != "), b, F.lit(")")) if s.is_mandatory else reason
        return F.when(same, 1.0).otherwise(0.0), F.when(same, hit).otherwise(miss), ~same if s.is_mandatory else no
    if s.match_type == "FUZZY":
        like = udfs.jaro_winkler(F.lower(a), F.lower(b))
        return like, F.when(like >= 0.85, F.concat(F.lit(f"High similarity on {s.name} ("), C.fixed(like * 100, 0), F.lit("%)"))), no
    if s.match_type == "NUMERIC_DELTA":
        near = C.numeric_delta(a, b)
        said = F.when(near == 1, f"Exact numeric match on {s.name}").when(near == 0.9, f"Close numeric value on {s.name}")
        return near, said, no
    return F.when(C.equal_fold(a, b), 1.0).otherwise(0.0), reason, no


def secondary_fields(pairs: DataFrame, fields: tuple[SecondaryField, ...], source: str = "source_attributes", dest: str = "dest_attributes") -> DataFrame:
    """``pairs`` with secondary_score, secondary_reasons and mandatory_failed over two attribute maps.

    A field that is empty on either side is left out; without any the score is 1. Else it is the weighted
    mean of the fields.
    """
    total, weight, reasons, failed = F.lit(0.0), F.lit(0.0), [], F.lit(False)
    for s in fields:
        a, b = (F.coalesce(F.trim(F.col(m)[key]), F.lit("")) for m, key in ((source, s.field_src), (dest, s.field_dest)))
        there = (a != "") & (b != "")
        score, reason, bad = _field(s, a, b)
        w = s.weight if s.weight > 0 else 0.10
        total = total + F.when(there, score * w).otherwise(0.0)
        weight = weight + F.when(there, F.lit(float(w))).otherwise(0.0)
        reasons.append(F.when(there, reason))
        failed = failed | (there & bad)
    said = F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")
    mean = F.when(weight > 0, total / weight).otherwise(F.lit(1.0))
    return pairs.withColumns({"secondary_score": mean, "secondary_reasons": said, "mandatory_failed": failed})


def blend_secondary(scored: DataFrame, fields: tuple[SecondaryField, ...]) -> DataFrame:
    """Drop mandatory mismatches and give the further fields a fifth of the total, if any are mapped."""
    if not fields:
        return scored.withColumns({"secondary_score": F.lit(0.0), "secondary_weight": F.lit(0.0)})
    out = secondary_fields(scored, fields).filter(~F.col("mandatory_failed"))
    out = out.withColumns({
        "total_score": F.col("total_score") * 0.8 + F.col("secondary_score") * 0.2,
        "secondary_weight": F.lit(0.2),
        "reasons": F.concat("reasons", "secondary_reasons"),
    })
    return out.drop("secondary_reasons", "mandatory_failed", "source_attributes", "dest_attributes")
