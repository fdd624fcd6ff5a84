"""A match run from two inputs to results."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions import udfs
from ..functions.names import ALIASES, STORED
from ..llm.common import stash
from ..operators import blocking, corpus, decision, records, results, scoring


@dataclass(frozen=True)
class MatchRun:
    """What a run gives. What is used more than once is stashed, which keeps plans short, until ``common.sweep``."""

    sources: DataFrame
    destinations: DataFrame
    candidates: DataFrame
    judged: DataFrame
    results: DataFrame

    def summary(self) -> DataFrame:
        return results.outcome(self.results)

    def hydrated(self) -> DataFrame:
        return results.hydrate(self.results, self.sources, self.destinations)

    def release(self) -> None:
        for df in (self.sources, self.destinations, self.candidates, self.judged):
            df.unpersist()


#: Records of one name that are worked on together.
SHARE = 4096
NAME_FIELDS = [f for f in udfs.NAME.names if f != "raw"]


@dataclass(frozen=True)
class Side:
    """One input. names: each distinct raw_name once with its fields, key (its first record's number), of (its records) and several (parties).

    forms: the distinct normalised names, see ``blocking.forms``; records: id, ordinal, raw_name, key, form, of, several and what else they have.
    usual: whether names are normalised with the aliases that scores use.
    """

    rows: DataFrame
    names: DataFrame
    forms: DataFrame
    records: DataFrame
    usual: bool = False

    def normalized(self) -> DataFrame:
        """Records with the fields of their normalised name."""
        return self.records.join(self.names.select("key", *NAME_FIELDS), "key").select(*self.rows.columns, *NAME_FIELDS)


def side(rows: DataFrame, aliases: dict[str, str]) -> Side:
    """A name is worked on once, however many records have it."""
    rows = rows.withColumn("raw_name", F.coalesce("raw_name", F.lit("")))
    found = rows.groupBy("raw_name").agg(F.min("ordinal").alias("key"), F.count("*").alias("of"))
    found = found.repartition(_parts(found), "key")  # for the work on names, which takes long beside their bytes
    found = found.withColumns({"named": udfs.normalize(F.col("raw_name"), aliases), "several": udfs.several_parties(F.col("raw_name"))})
    found = found.select("raw_name", "key", "of", "several", *(F.col(f"named.{f}").alias(f) for f in NAME_FIELDS))
    found = stash(found, "names")
    forms = stash(blocking.forms(found.withColumn("ordinal", F.col("key"))), "forms")
    which = found.join(forms.select(*blocking.FIELDS, F.col("id").alias("form")), list(blocking.FIELDS)).select("raw_name", "key", "of", "several", "form")
    return Side(rows, found, forms, stash(rows.join(which, "raw_name"), "records"), aliases == ALIASES)


def with_weights(both: DataFrame, left: DataFrame, right: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The distinct names ``left`` and ``right`` with the corpus weights of their tokens and of their parties' tokens.

    both: names of either side with tokens and of, the number of records.
    """
    weighted = corpus.weights(corpus.frequencies(both), n)

    def of(names: DataFrame, side: str) -> DataFrame:
        vocabulary = F.flatten(udfs.party_tokens(F.col(f"{side}_name")))
        named = names.select(F.col(f"{side}_key").alias("id"), F.array_union("tokens", vocabulary).alias("vocabulary"))
        found = corpus.token_weights(named, weighted).select(F.col("id").alias(f"{side}_key"), F.col("weights").alias(f"{side}_weights"))
        return names.drop("tokens").join(found, f"{side}_key", "left")

    return of(left, "source"), of(right, "dest")


def _parts(pairs: DataFrame) -> int:
    """Pairs are dealt to more tasks than their bytes ask for, as each takes long."""
    return 4 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _gathered(pairs: DataFrame) -> DataFrame:
    """Pairs of names in ranges by the source's rarest token: sources that share it share most candidates, so a task meets few distinct names.

    Ranges go on by the source, so that a token of very many names is dealt to several tasks.
    """
    rare = F.col("source_name")
    if "source_weights" in pairs.columns:
        heaviest = F.array_max(F.transform(F.map_entries("source_weights"), lambda x: F.struct(x["value"], x["key"])))
        rare = F.coalesce(heaviest["key"], rare)
    pairs = pairs.withColumn("rare", rare).repartitionByRange(_parts(pairs), "rare", "source_key")
    return pairs.sortWithinPartitions("rare", "source_key").drop("rare")


def score_records(pairs: DataFrame, left_names: DataFrame, right_names: DataFrame, config: MatchConfig) -> DataFrame:
    """Pairs of records with all scores. A pair of names and days is scored once, however many records have it."""
    key = ["source_key", "dest_key", "apart"]
    pairs = pairs.withColumn("apart", F.coalesce("days", F.lit(1 << 30))).drop("days")  # a key that is never null lets the join hash
    asked = pairs.select(*key).distinct().join(left_names, "source_key").join(right_names, "dest_key")
    asked = asked.withColumn("days", F.when(F.col("apart") != 1 << 30, F.col("apart")))
    # a task meets few distinct destinations, whose fields are split and compared as often as they are met
    asked = asked.repartitionByRange(_parts(asked), "dest_key", "source_key", "apart").sortWithinPartitions("dest_key", "source_key")
    return pairs.join(scoring.score_pairs(asked, config.rules()), key).drop(*key)


def stored(rows: Side, side: str, named: DataFrame) -> DataFrame:
    """The names ``named`` of a side with the fields that scores need, if those are what scores would make of them."""
    if not rows.usual:
        return named
    texts = [(F.concat_ws(" ", f) if f == "numbers" else F.col(f)).alias(f"{side}_{f}") for f in STORED]
    return named.join(rows.names.select(F.col("key").alias(f"{side}_key"), *texts), f"{side}_key")


def score_candidates(found: DataFrame, left: Side, right: Side, n: int, config: MatchConfig) -> DataFrame:
    """Candidates of names (``blocking.of_names``) as pairs of records with all scores, those that the review threshold may keep.

    Names of one party each are scored once, whatever the dates of their records: a date takes part after
    that, in expressions. Where a field names several parties the date decides which count, so each
    distance of dates is scored. Where further fields can lift a pair, all pairs are.
    """
    rules, attributes = config.rules(), bool(config.mapping.secondary)
    own = lambda rows, name: rows.names.select("raw_name", F.col("key").alias(f"{name}_key"), "tokens").withColumnRenamed("raw_name", f"{name}_name")
    left_names, right_names = own(left, "source"), own(right, "dest")
    if config.metrics.corpus_idf:
        both = left.names.select("tokens", "of").unionByName(right.names.select("tokens", "of"))
        left_names, right_names = (stash(names, "weighted") for names in with_weights(both, left_names, right_names, n))
    else:
        left_names, right_names = left_names.drop("tokens"), right_names.drop("tokens")
    taken = left.records.select(F.col("id").alias("source_id"), F.col("key").alias("source_key"), F.col("form").alias("source_name"), F.col("transaction_date").alias("source_date"), F.col("several").alias("_several"), "of", *([F.col("attributes").alias("source_attributes")] if attributes else []))
    days = F.datediff("source_date", "dest_date")
    several = F.lit(True) if attributes else F.col("_several") | F.col("dest_several")

    out = []
    if attributes or not left.names.filter("several").isEmpty() or not right.names.filter("several").isEmpty():
        pairs = found.join(taken, "source_name").filter(several).withColumn("days", days)
        pairs = pairs.select("source_id", "dest_id", "source_key", "dest_key", "days", *([x for x in pairs.columns if x.endswith("_attributes")]))
        scored = score_records(pairs, left_names, right_names, config)
        out.append(scored.withColumn("said", F.lit(None).cast("int")))
    if not attributes and (not out or not left.names.filter("NOT several").isEmpty() and not right.names.filter("NOT several").isEmpty()):
        which = left.names.filter("NOT several").select(F.col("key").alias("source_key"), *blocking.FIELDS, F.col("of").alias("_of"))
        which = which.join(left.forms.select(*blocking.FIELDS, F.col("id").alias("source_name")), list(blocking.FIELDS)).select("source_key", "source_name", "_of")
        single = found.filter("NOT dest_several").join(which, "source_name").drop("source_name")
        asked = single.select("source_key", "dest_key").distinct().join(stored(left, "source", left_names), "source_key").join(stored(right, "dest", right_names), "dest_key")
        scored = scoring.score_names(_gathered(asked), rules).filter(scoring.most_total(rules) >= config.review_threshold)
        # a name's records meet its candidates in shares, so that a frequent name's aren't in one task
        single = single.join(scored, ["source_key", "dest_key"]).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_of") / SHARE))))
        mine = taken.filter("NOT _several").withColumn("share", F.pmod(F.xxhash64("source_id"), F.floor(F.col("of") / SHARE) + 1))
        pairs = single.join(mine.select("source_id", "source_key", "share", "source_date"), ["source_key", "share"]).withColumn("days", days)
        pairs = scoring.dated(pairs, rules).withColumn("reasons", F.lit(None).cast("array<string>"))
        columns = ["source_id", "dest_id", *scoring.SCORES, "cross_script", "reasons", "said"]
        pairs = pairs.select(*columns, *(["source_key", "share"] if not out else [])).filter(F.col("total_score") >= config.review_threshold)
        out.append(pairs)
    return scoring.blend_secondary(reduce(DataFrame.unionByName, out), config.mapping.secondary)


def match_records(sources: DataFrame, destinations: DataFrame, config: MatchConfig = MatchConfig(), batch_id: str = "batch", calibrate=None, aliases: dict[str, str] = ALIASES) -> MatchRun:
    """Match built records. An empty side gives no rows at all, not even unmatched ones."""
    left, right = side(sources, aliases), side(destinations, aliases)
    n_src, n_dst = left.records.count(), right.records.count()
    offered = right.records.select(F.col("form").alias("dest_name"), F.col("id").alias("dest_id"), F.col("ordinal").alias("dest_ordinal"), F.col("key").alias("dest_key"), F.col("transaction_date").alias("dest_date"), F.col("several").alias("dest_several"), *([F.col("attributes").alias("dest_attributes")] if config.mapping.secondary else []))
    if n_src and n_dst:
        found = blocking.of_names(left.forms, right.forms, offered, n_dst, config)
    else:
        found = offered.limit(0).withColumnsRenamed({"dest_name": "source_name"}).withColumns({"hits": F.lit(0).cast("long"), "place": F.lit(0)})
    found = stash(found, "candidates")
    ids = left.records.select(F.col("id").alias("source_id"), F.col("form").alias("source_name"))
    asked = ids if n_dst else ids.limit(0)
    scored = score_candidates(found, left, right, n_src + n_dst, config)
    within = tuple(c for c in ("source_key", "share") if c in scored.columns)
    kept = stash(decision.decided(decision.ranked(scored, config, within), config, calibrate).drop(*within), "judged")
    told = lambda rows: rows.withColumn("reasons", F.when(F.col("said").isNull(), F.col("reasons")).otherwise(scoring.reasons(F.col("said")))).drop("said")
    out = told(decision.assigned(kept, config))
    if config.emit_unmatched and config.assignment_strategy != "TOP_1":
        out = out.unionByName(decision.unmatched(asked, found.select("source_name").distinct(), kept), allowMissingColumns=True).withColumn("rank", F.coalesce("rank", F.lit(0)))
    ident = F.concat_ws("-", F.lit(batch_id), "source_id", F.coalesce("dest_id", F.lit("NO_MATCH")))
    out = out.withColumns({"id": ident, "batch_id": F.lit(batch_id), "created_at": F.current_timestamp()}).withColumnRenamed("total_score", "confidence_score")
    pairs = ids.join(found, "source_name").select("source_id", "dest_id", "dest_ordinal", "hits", "place")
    return MatchRun(left.normalized(), right.normalized(), pairs, told(kept), out)


def match(source_rows: DataFrame, dest_rows: DataFrame, config: MatchConfig = MatchConfig(), batch_id: str = "batch", calibrate=None, aliases: dict[str, str] = ALIASES) -> MatchRun:
    """Match two inputs of any columns under the configured mapping."""
    return match_records(records.sources(source_rows, config.mapping), records.destinations(dest_rows, config.mapping), config, batch_id, calibrate, aliases)


def adjudicate(pairs: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Local judgement of pairs (source_name, dest_name, source_date, dest_date as ISO text): scores without a corpus and a verdict.

    EXACT if the dates agree and the pair is a match, CLOSE from the review threshold on, else MISMATCH;
    entity_type is CORPORATE if either name carries a legal form.
    """
    day = lambda c: F.try_to_date(F.col(c), "yyyy-MM-dd")
    rows = pairs.withColumns({"days": F.datediff(day("source_date"), day("dest_date")), "_a": F.col("source_name"), "_b": F.col("dest_name")})
    scored = scoring.score_pairs(rows, config.rules())
    legal = r"(?i)(บริษัท|บจก|บมจ|ห้างหุ้นส่วนจำกัด|หจก|จำกัด|company|co\.|ltd|corp|inc|llc|plc)"
    close: Column = F.col("total_score") >= config.review_threshold
    verdict = F.when(close & (F.col("date_score") == 1), "EXACT").when(close, "CLOSE").otherwise("MISMATCH")
    kind = F.when(F.col("_a").rlike(legal) | F.col("_b").rlike(legal), "CORPORATE").otherwise("PERSONAL")
    return scored.withColumns({"verdict": verdict, "entity_type": kind}).withColumnsRenamed({"_a": "source_name", "_b": "dest_name"})
