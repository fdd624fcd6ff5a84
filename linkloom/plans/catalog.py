"""Registered queries of the reference operators, each over whole tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ColumnMapping, MatchConfig, SecondaryField
from ..functions import columns as C
from ..functions import udfs
from ..operators import blocking, calibration, corpus, decision, evaluation, records, results, review, scoring
from ..sources import connectors
from ..streaming import incremental
from . import engine, labelled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as sources (name, brand) and as destinations (brand, name), with the fields that keys come from."""
    part = table(spark, sf_dir, "part")

    def named(prefix: str, *order: str) -> DataFrame:
        cleaned = C.clean_ascii(F.concat_ws(" ", *order))
        rows = part.select(F.concat(F.lit(prefix), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("ordinal"), cleaned.alias("cleaned"))
        return rows.withColumns({"tokens": F.split("cleaned", " "), "phonetic_key": F.lit(""), "romanized": F.lit("")})

    return named("src-", "p_name", "p_brand"), named("dest-", "p_brand", "p_name")


CLEAN = r"trim(regexp_replace(CASE WHEN trim(regexp_replace(lower(trim({0})), '([A-Za-z]{{2,}}[0-9]{{5,}}|[0-9]{{8,}})[\t\n\f\r ]*$', '')) = '' THEN lower(trim({0})) ELSE trim(regexp_replace(lower(trim({0})), '([A-Za-z]{{2,}}[0-9]{{5,}}|[0-9]{{8,}})[\t\n\f\r ]*$', '')) END, '[^a-zA-Z0-9]+', ' ', 'g'))"
SIDES = f"""
    s AS (SELECT 'src-' || p_partkey AS id, p_partkey AS ordinal, {CLEAN.format("(p_name || ' ' || p_brand)")} AS cleaned FROM part),
    d AS (SELECT 'dest-' || p_partkey AS id, p_partkey AS ordinal, {CLEAN.format("(p_brand || ' ' || p_name)")} AS cleaned FROM part)
"""
KEYS = """
    {0}k AS (SELECT id, ordinal, kind, key, count(*) AS tf FROM (
        SELECT id, ordinal, 'token' AS kind, unnest(string_split(cleaned, ' ')) AS key FROM {0}
        UNION ALL
        SELECT id, ordinal, 'trigram' AS kind, substr('  ' || cleaned || ' ', i, 3) AS key FROM (SELECT *, unnest(range(1, length(cleaned) + 2)) AS i FROM {0})
    ) WHERE kind = 'trigram' OR length(key) >= 2 GROUP BY ALL)
"""
HITS = """
    n AS (SELECT count(*) AS n, CASE WHEN count(*) >= 1000 THEN least(CAST(floor(count(*) * 0.05) AS BIGINT), 2000) ELSE 9223372036854775807 END AS cut FROM part),
    f AS (SELECT kind, key FROM dk GROUP BY ALL HAVING sum(tf) <= (SELECT cut FROM n)),
    h AS (SELECT sk.id AS source_id, dk.id AS dest_id, dk.ordinal AS dest_ordinal, CAST(sum(CASE sk.kind WHEN 'token' THEN 3 ELSE 1 END * sk.tf * dk.tf) AS BIGINT) AS hits
          FROM sk JOIN f USING (kind, key) JOIN dk USING (kind, key) GROUP BY ALL)
"""
BLOCKS = f"WITH {SIDES}, {KEYS.format('s')}, {KEYS.format('d')}, {HITS}"


@query(rf"""SELECT c_custkey, {CLEAN.format("c_name")} AS cleaned, regexp_extract_all(lower(trim(c_name)), '\b[0-9]+\b') AS numbers FROM customer""")
def normalize_basic(spark, sf_dir):
    """Reference code, letters and digits, numbers of the customers' names."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", C.clean_ascii(F.col("c_name")).alias("cleaned"), C.numbers(F.lower(F.trim("c_name"))).alias("numbers"))


@query(f"""WITH {SIDES}, t AS (SELECT DISTINCT 's' || id AS r, unnest(string_split(cleaned, ' ')) AS token FROM s UNION SELECT DISTINCT 'd' || id, unnest(string_split(cleaned, ' ')) FROM d),
    n AS (SELECT 2 * count(*) AS n FROM part), g AS (SELECT token, count(*) AS df FROM t GROUP BY token)
    SELECT token, df, least(greatest(ln(1 + n / (1 + df)) / ln(1 + n), 0.0), 1.0) AS weight FROM g, n""")
def corpus_idf(spark, sf_dir):
    """Document frequency and weight of every token of both sides."""
    s, d = part_names(spark, sf_dir)
    both = s.unionByName(d)
    n = both.count()
    return corpus.weights(corpus.frequencies(both), n)


@query(f"WITH {SIDES}, {KEYS.format('d')} SELECT kind, key, CAST(sum(tf) AS BIGINT) AS freq FROM dk GROUP BY kind, key")
def blocking_keys(spark, sf_dir):
    """Occurrences of every blocking key in the destinations."""
    return blocking.key_frequencies(blocking.keys(part_names(spark, sf_dir)[1]))


@query(f"{BLOCKS} SELECT source_id, dest_id, hits FROM h")
def blocking_hits(spark, sf_dir):
    """Weighted hits of every pair that shares a key below the cutoff."""
    s, d = part_names(spark, sf_dir)
    return blocking.hits(blocking.keys(s), blocking.keys(d), blocking.cutoff(d.count())).select("source_id", "dest_id", "hits")


@query(f"{BLOCKS} SELECT source_id, dest_id, hits, place FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY hits DESC, dest_ordinal) AS place FROM h) WHERE place <= 50")
def blocking_topk(spark, sf_dir):
    """The 50 best destinations of every source."""
    s, d = part_names(spark, sf_dir)
    return blocking.best(s, d, 50, blocking.cutoff(d.count()))[0].select("source_id", "dest_id", "hits", "place")


@query(f"""WITH {SIDES}, {KEYS.format('s')}, {KEYS.format('d')},
    f AS (SELECT kind, key FROM dk GROUP BY ALL HAVING sum(tf) <= 3), h AS (SELECT DISTINCT sk.id FROM sk JOIN f USING (kind, key)),
    l AS (SELECT id, substr(cleaned, 1, 3) AS p FROM s WHERE length(cleaned) >= 3 AND id NOT IN (SELECT id FROM h)),
    x AS (SELECT id, substr(cleaned, 1, 3) AS p, row_number() OVER (PARTITION BY substr(cleaned, 1, 3) ORDER BY ordinal) AS place FROM s)
    SELECT l.id AS source_id, x.id AS dest_id, place FROM l JOIN x USING (p) WHERE place <= 5""")
def no_hit_fallback(spark, sf_dir):
    """Under a cutoff of 3 occurrences: the first five records of the same prefix for records without a hit."""
    s, d = part_names(spark, sf_dir)
    found = blocking.hits(blocking.keys(s), blocking.keys(d), 3)
    return blocking.prefix_fallback(s, s, found, 5).select("source_id", "dest_id", "place")


PAIRS = "SELECT DISTINCT a.p_name AS a, b.p_type AS b FROM lineitem JOIN part a ON l_partkey = a.p_partkey JOIN part b ON l_suppkey = b.p_partkey"


def text_pairs(spark, sf_dir) -> DataFrame:
    """Distinct pairs of a part's name and another one's type, along the line items."""
    part = table(spark, sf_dir, "part")
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    left = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("a"))
    right = part.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_type").alias("b"))
    return line.join(left, "l_partkey").join(right, "l_suppkey").select("a", "b").distinct()


@query(f"""WITH p AS ({PAIRS}), g AS (SELECT a, b, 'a' AS side, substr('  ' || lower(a) || ' ', i, 3) AS t FROM (SELECT *, unnest(range(1, length(a) + 2)) AS i FROM p)
        UNION ALL SELECT a, b, 'b', substr('  ' || lower(b) || ' ', i, 3) FROM (SELECT *, unnest(range(1, length(b) + 2)) AS i FROM p)),
    c AS (SELECT a, b, t, count(*) FILTER (side = 'a') AS x, count(*) FILTER (side = 'b') AS y FROM g GROUP BY ALL)
    SELECT a, b, CAST(sum(least(x, y)) AS DOUBLE) / CAST(sum(x) + sum(y) - sum(least(x, y)) AS DOUBLE) AS similarity FROM c GROUP BY a, b""")
def trigram_similarity(spark, sf_dir):
    """Multiset Jaccard of trigrams."""
    return text_pairs(spark, sf_dir).withColumn("similarity", C.trigram_similarity(F.col("a"), F.col("b")))


@query(f"SELECT a, b, CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1 - CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b)) END AS similarity FROM ({PAIRS})")
def levenshtein_similarity(spark, sf_dir):
    """Edit distance over the longer length."""
    return text_pairs(spark, sf_dir).withColumn("similarity", C.levenshtein_similarity(F.col("a"), F.col("b")))


@query(f"SELECT a, b, len(list_intersect(string_split(lower(a), ' '), string_split(lower(b), ' '))) > 0 AS shared FROM ({PAIRS})")
def token_overlap(spark, sf_dir):
    """Whether two texts have a token in common."""
    return text_pairs(spark, sf_dir).withColumn("shared", F.arrays_overlap(F.split(F.lower("a"), " "), F.split(F.lower("b"), " ")))


@query(r"""WITH t AS (SELECT o_orderkey, regexp_extract_all(o_orderpriority || ' ' || CAST(o_orderkey % 7 AS VARCHAR), '\b[0-9]+\b') AS a, regexp_extract_all(o_orderpriority || ' ' || CAST(o_custkey % 7 AS VARCHAR), '\b[0-9]+\b') AS b FROM orders)
    SELECT o_orderkey, len(a) > 0 AND len(b) > 0 AND list_sort(list_distinct(a)) <> list_sort(list_distinct(b)) AS mismatch FROM t""")
def number_mismatch(spark, sf_dir):
    """Whether the sets of numbers of two texts differ."""
    o = table(spark, sf_dir, "orders")
    text = lambda c: C.numbers(F.concat("o_orderpriority", F.lit(" "), (F.col(c) % 7).cast("string")))
    return o.select("o_orderkey", C.number_mismatch(text("o_orderkey"), text("o_custkey")).alias("mismatch"))


ORDER_LINES = "orders JOIN lineitem ON o_orderkey = l_orderkey"


def order_lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))


@query(f"""SELECT o_orderkey, l_linenumber, CASE WHEN abs(date_diff('day', CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE))) > 30 THEN 0.0
    ELSE floor(exp(-0.05 * abs(date_diff('day', CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)))) * 10000 + 0.5) / 10000 END AS score FROM {ORDER_LINES}""")
def date_score(spark, sf_dir):
    """Closeness of order and shipping date under a tolerance of 30 days."""
    return order_lines(spark, sf_dir).select("o_orderkey", "l_linenumber", C.date_score(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date"), 30).alias("score"))


@query("""SELECT o_orderkey, form, CAST(o_orderdate AS DATE) AS parsed FROM orders, (SELECT unnest(['iso', 'slashes', 'compact', 'day_first', 'buddhist', 'named', 'timed', 'bad']) AS form) WHERE form <> 'bad'
    UNION ALL SELECT o_orderkey, 'bad', NULL FROM orders""")
def parse_dates(spark, sf_dir):
    """Order dates written in eight ways and read again."""
    d = F.col("o_orderdate").cast("date")
    buddhist = F.concat(F.date_format(d, "dd/MM/"), (F.year(d) + 543).cast("string"))
    forms = {"iso": F.date_format(d, "yyyy-MM-dd"), "slashes": F.date_format(d, "yyyy/MM/dd"), "compact": F.date_format(d, "yyyyMMdd"), "day_first": F.date_format(d, "dd/MM/yyyy"), "buddhist": buddhist, "named": F.date_format(d, "d MMMM yyyy"), "timed": F.date_format(d, "dd-MM-yyyy HH:mm"), "bad": F.lit("2023-02-30")}
    each = F.inline(F.array(*(F.struct(F.lit(k).alias("form"), v.alias("text")) for k, v in forms.items())))
    return table(spark, sf_dir, "orders").select("o_orderkey", each).select("o_orderkey", "form", C.parse_date(F.col("text")).alias("parsed"))


FIELDS = (SecondaryField("size", "size", "size", "EXACT", 0.5, True), SecondaryField("price", "price", "price", "NUMERIC_DELTA", 0.3), SecondaryField("brand", "brand", "brand", "OTHER", 0.0))


@query(f"""WITH p AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS size, p_retailprice AS price, p_brand AS brand FROM part),
    j AS (SELECT a.*, b.size AS size2, b.price AS price2, b.brand AS brand2, b.p_partkey AS other FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN p a ON l_partkey = a.p_partkey JOIN p b ON l_suppkey = b.p_partkey)
    SELECT p_partkey, other, (CASE WHEN size = size2 THEN 1.0 ELSE 0.0 END * 0.5::DOUBLE + CASE WHEN price = price2 THEN 1.0::DOUBLE WHEN abs(price - price2) <= 0.01::DOUBLE * greatest(price, price2) THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END * 0.3::DOUBLE
        + CASE WHEN lower(brand) = lower(brand2) THEN 1.0 ELSE 0.0 END * 0.1::DOUBLE) / (0.5::DOUBLE + 0.3::DOUBLE + 0.1::DOUBLE) AS secondary_score, size <> size2 AS mandatory_failed FROM j""")
def secondary_fields(spark, sf_dir):
    """Weighted agreement of size, price and brand of parts and the parts numbered as their suppliers."""
    part = table(spark, sf_dir, "part")
    attributes = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("price"), F.col("p_retailprice").cast("string"), F.lit("brand"), F.col("p_brand"))
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    left = part.select(F.col("p_partkey").alias("l_partkey"), attributes.alias("source_attributes"))
    right = part.select(F.col("p_partkey").alias("l_suppkey"), attributes.alias("dest_attributes"))
    pairs = line.join(left, "l_partkey").join(right, "l_suppkey")
    out = scoring.secondary_fields(pairs, FIELDS)
    return out.select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("other"), "secondary_score", "mandatory_failed")


# A score that SQL can compute, over the distinct part and supplier pairs of the line items.
SCORED = "SELECT DISTINCT 'src-' || l_partkey AS source_id, 'dest-' || l_suppkey AS dest_id, ((l_partkey * 7919 + l_suppkey * 104729) % 10000) / 10000.0::DOUBLE AS total_score, (l_partkey + l_suppkey) % 5 = 0 AS cross_script FROM lineitem"
RANKED = f"""c AS ({SCORED}), k AS (SELECT * FROM c WHERE total_score >= 0.7),
    r0 AS (SELECT *, row_number() OVER w AS rank, lead(total_score) OVER w AS nxt FROM k WINDOW w AS (PARTITION BY source_id ORDER BY total_score DESC, dest_id)),
    r1 AS (SELECT *, CASE WHEN rank = 1 THEN coalesce(nxt, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS runner_up FROM r0),
    r AS (SELECT *, CASE WHEN rank = 1 THEN total_score - runner_up ELSE 0.0::DOUBLE END AS score_margin FROM r1 WHERE rank <= 5)"""
JUDGED = """{name} AS (SELECT *, CASE WHEN cross_script THEN 0.84::DOUBLE ELSE 0.9::DOUBLE END AS bar, total_score >= 0.99::DOUBLE AND {up} < 0.99::DOUBLE AS exact FROM r)"""
NOTE = "CASE WHEN exact THEN printf('Exact normalized match; best fuzzy alternative scored %.3f', {up}) WHEN total_score >= bar AND total_score - {up} >= 0.05::DOUBLE THEN 'Top candidate meets auto-match threshold and margin threshold' WHEN total_score >= bar THEN printf('Ambiguous: runner-up within %.3f — needs review', total_score - {up}) ELSE 'Below auto-match threshold — needs review' END"
AUTO = "(exact OR (total_score >= bar AND total_score - {up} >= 0.05::DOUBLE))"
DECIDED = f"""{RANKED}, {JUDGED.format(name="j", up="runner_up")},
    e AS (SELECT *, CASE WHEN rank = 1 AND {AUTO.format(up="runner_up")} THEN 'AUTO_MATCHED' ELSE 'REVIEW_NEEDED' END AS match_status,
        CASE WHEN rank = 1 THEN {NOTE.format(up="runner_up")} ELSE printf('Alternative candidate (rank %d) for review', rank) END AS decision_note FROM j)"""
GREEDY = f"""{DECIDED}, w AS (SELECT *, row_number() OVER (PARTITION BY dest_id, match_status = 'AUTO_MATCHED' ORDER BY total_score DESC, source_id) AS claim FROM e),
    b AS (SELECT dest_id, source_id AS winner, total_score AS won FROM w WHERE match_status = 'AUTO_MATCHED' AND claim = 1),
    g AS (SELECT w.source_id, w.dest_id, total_score, cross_script, rank, CASE WHEN match_status = 'AUTO_MATCHED' AND winner <> source_id THEN 'REVIEW_NEEDED' ELSE match_status END AS match_status,
        CASE WHEN match_status = 'AUTO_MATCHED' AND winner <> source_id THEN printf('Destination already assigned to %s at %.3f', winner, won) ELSE decision_note END AS decision_note FROM w LEFT JOIN b USING (dest_id))"""
SHOWN = ("source_id", "dest_id", "total_score", "rank", "match_status", "decision_note")


def scored_pairs(spark, sf_dir) -> DataFrame:
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    score = ((part * 7919 + supp * 104729) % 10000) / 10000.0
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return line.select(F.concat(F.lit("src-"), part.cast("string")).alias("source_id"), F.concat(F.lit("dest-"), supp.cast("string")).alias("dest_id"), score.alias("total_score"), ((part + supp) % 5 == 0).alias("cross_script"))


def strategy(spark, sf_dir, name: str) -> DataFrame:
    config = MatchConfig(assignment_strategy=name)
    return decision.assigned(decision.decided(decision.ranked(scored_pairs(spark, sf_dir), config), config), config)


@query(f"WITH {RANKED} SELECT source_id, dest_id, rank, runner_up, score_margin FROM r")
def rank_margin(spark, sf_dir):
    """Ranks and margins of the candidates at or above the review threshold."""
    return decision.ranked(scored_pairs(spark, sf_dir)).select("source_id", "dest_id", "rank", "runner_up", "score_margin")


@query(f"WITH {DECIDED} SELECT {', '.join(SHOWN)} FROM e")
def decide(spark, sf_dir):
    """Status and note of every ranked candidate."""
    return decision.decided(decision.ranked(scored_pairs(spark, sf_dir))).select(*SHOWN)


@query(f"WITH {GREEDY} SELECT {', '.join(SHOWN)} FROM g")
def greedy_1_1(spark, sf_dir):
    """One source per destination."""
    return strategy(spark, sf_dir, "GREEDY_1_1").select(*SHOWN)


@query(f"WITH {DECIDED} SELECT {', '.join(SHOWN)} FROM e WHERE rank = 1")
def top_1(spark, sf_dir):
    """The first rank alone."""
    return strategy(spark, sf_dir, "TOP_1").select(*SHOWN)


@query(f"""WITH {RANKED}, {JUDGED.format(name="j", up="0.0::DOUBLE")} SELECT source_id, dest_id, total_score, rank, CASE WHEN {AUTO.format(up="0.0::DOUBLE")} THEN 'AUTO_MATCHED' ELSE 'REVIEW_NEEDED' END AS match_status,
    CASE WHEN rank = 1 THEN {NOTE.format(up="0.0::DOUBLE")} ELSE printf('%s (rank %d of several valid links)', {NOTE.format(up="0.0::DOUBLE")}, rank) END AS decision_note FROM j""")
def all_candidates(spark, sf_dir):
    """Every candidate on its own score."""
    return strategy(spark, sf_dir, "ALL_CANDIDATES").select(*SHOWN)


UNMATCHED = """u AS (SELECT 'src-' || p_partkey AS source_id, 'NO_MATCH' AS match_status, CASE WHEN 'src-' || p_partkey IN (SELECT source_id FROM c) THEN 'All blocking candidates scored below review threshold' ELSE 'No blocking candidates found' END AS decision_note
    FROM part WHERE 'src-' || p_partkey NOT IN (SELECT source_id FROM k))"""


def unmatched_parts(spark, sf_dir, pairs: DataFrame, kept: DataFrame) -> DataFrame:
    sources = table(spark, sf_dir, "part").select(F.concat(F.lit("src-"), F.col("p_partkey").cast("string")).alias("id"))
    return decision.unmatched(sources, pairs, kept)


@query(f"WITH {RANKED}, {UNMATCHED} SELECT * FROM u")
def no_match_rows(spark, sf_dir):
    """Parts without a candidate at or above the review threshold."""
    pairs = scored_pairs(spark, sf_dir)
    return unmatched_parts(spark, sf_dir, pairs, decision.ranked(pairs))


@query(f"""WITH c AS ({SCORED}), s AS (SELECT 'src-' || p_partkey AS source_id FROM part UNION ALL SELECT 'cust-' || c_custkey FROM customer)
    SELECT source_id, 'NO_MATCH' AS match_status,
        CASE WHEN source_id IN (SELECT source_id FROM c) THEN 'All blocking candidates scored below review threshold' ELSE 'No blocking candidates found' END AS decision_note
    FROM s WHERE source_id NOT IN (SELECT source_id FROM c WHERE total_score >= 0.98)""")
def no_match_strict(spark, sf_dir):
    """Parts without a candidate at 0.98 or above, and customers, who have no candidate at all."""
    ids = [table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id")) for name, prefix, key in (("part", "src-", "p_partkey"), ("customer", "cust-", "c_custkey"))]
    pairs = scored_pairs(spark, sf_dir)
    return decision.unmatched(ids[0].unionByName(ids[1]), pairs, decision.ranked(pairs, MatchConfig(review_threshold=0.98)))


STORED = f"{GREEDY}, {UNMATCHED}, st AS (SELECT source_id, dest_id, total_score AS confidence_score, rank, match_status, decision_note FROM g UNION ALL SELECT source_id, NULL, NULL, 0, match_status, decision_note FROM u)"


def stored(spark, sf_dir) -> DataFrame:
    """Results as they are stored: assigned pairs and unmatched sources."""
    pairs = scored_pairs(spark, sf_dir)
    out = strategy(spark, sf_dir, "GREEDY_1_1")
    out = out.unionByName(unmatched_parts(spark, sf_dir, pairs, out), allowMissingColumns=True)
    return out.select("source_id", "dest_id", F.col("total_score").alias("confidence_score"), F.coalesce("rank", F.lit(0)).alias("rank"), "match_status", "decision_note")


@query(f"WITH {STORED} SELECT match_status, count(*) AS n FROM st GROUP BY match_status")
def status_counts(spark, sf_dir):
    return results.counts_by_status(stored(spark, sf_dir))


@query(f"""WITH {STORED}, o AS (SELECT count(*) FILTER (match_status IN ('AUTO_MATCHED', 'CONFIRMED')) AS auto_matched, count(*) FILTER (match_status = 'REVIEW_NEEDED') AS review_needed, count(*) FILTER (match_status = 'NO_MATCH') AS no_match, count(*) AS total FROM st)
    SELECT *, total > 0 AND (auto_matched / total < 0.5 OR no_match / total > 0.3) AS anomaly FROM o""")
def anomaly(spark, sf_dir):
    """Outcome counters of a run and whether they are out of the ordinary."""
    return results.outcome(stored(spark, sf_dir))


@query(f"WITH {STORED} SELECT source_id, dest_id, confidence_score, match_status FROM st ORDER BY confidence_score DESC NULLS LAST, source_id, dest_id LIMIT 200 OFFSET 200")
def results_page(spark, sf_dir):
    """The second page of 200 results by falling score."""
    rows = stored(spark, sf_dir).withColumn("id", F.concat_ws("", "source_id", F.lit(" "), "dest_id"))
    return results.page(rows, results.ResultsQuery(sort="confidence_score", direction="DESC", page=2, limit=500)).select("source_id", "dest_id", "confidence_score", "match_status")


HYDRATED = f"{STORED}, hy AS (SELECT st.*, p_name AS source_name, 'SRC-' || p_partkey AS reference_id, s_name AS dest_name, 'DEST-' || s_suppkey AS customer_id FROM st LEFT JOIN part ON source_id = 'src-' || p_partkey LEFT JOIN supplier ON dest_id = 'dest-' || s_suppkey)"


def hydrated(spark, sf_dir) -> DataFrame:
    key = lambda c, p: F.concat(F.lit(p), F.col(c).cast("string"))
    none = F.lit(None).cast("date").alias("transaction_date")
    left = table(spark, sf_dir, "part").select(key("p_partkey", "src-").alias("id"), key("p_partkey", "SRC-").alias("reference_id"), F.col("p_name").alias("raw_name"), none)
    right = table(spark, sf_dir, "supplier").select(key("s_suppkey", "dest-").alias("id"), key("s_suppkey", "DEST-").alias("customer_id"), F.col("s_name").alias("raw_name"), none)
    return results.hydrate(stored(spark, sf_dir), left, right)


@query(f"WITH {HYDRATED} SELECT source_id, dest_id, source_name, reference_id, dest_name, customer_id FROM hy")
def hydrate(spark, sf_dir):
    """Results with the records of both sides."""
    return hydrated(spark, sf_dir).select("source_id", "dest_id", "source_name", "reference_id", "dest_name", "customer_id")


@query(f"WITH {HYDRATED} SELECT source_id, dest_id, match_status FROM hy WHERE match_status = 'REVIEW_NEEDED' AND rank <= 1 AND (contains(lower(coalesce(source_name, '')), '1_0') OR contains(lower(coalesce(dest_name, '')), '1_0') OR contains(lower(coalesce(reference_id, '')), 'c-1') OR contains(lower(coalesce(customer_id, '')), 'c-1'))")
def search(spark, sf_dir):
    """First-rank results to review whose reference contains a text."""
    q = results.ResultsQuery(status="REVIEW_NEEDED", search="C-1", rank1_only=True)
    return results.matching(hydrated(spark, sf_dir), q).select("source_id", "dest_id", "match_status")


@query("SELECT s_suppkey AS ordinal, s_name AS raw_name FROM supplier WHERE contains(lower(s_name), 'r#0000000') ORDER BY s_suppkey LIMIT 30")
def destination_search(spark, sf_dir):
    """The first 30 suppliers whose name contains a text."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ordinal"), F.col("s_name").alias("raw_name"), F.lit("").alias("customer_id"))
    return results.search_destinations(rows, "R#0000000").select("ordinal", "raw_name")


@query(f"WITH {HYDRATED} SELECT source_id, reference_id, coalesce(source_name, '') AS source_name, coalesce(dest_id, '') AS dest_id, coalesce(customer_id, '') AS customer_id, coalesce(dest_name, '') AS dest_name, printf('%.4f', coalesce(confidence_score, 0.0::DOUBLE)) AS confidence_score, match_status, decision_note FROM hy")
def export_rows(spark, sf_dir):
    """Rows of the results file."""
    rows = hydrated(spark, sf_dir).withColumns({"batch_id": F.lit("b"), "reasons": F.array().cast("array<string>")})
    return results.export_rows(rows).select("source_id", "reference_id", "source_name", "dest_id", "customer_id", "dest_name", "confidence_score", "match_status", "decision_note")


@query(f"WITH {STORED}, bb AS (SELECT *, 'batch-' || (CAST(substr(source_id, 5) AS BIGINT) % 7) AS batch_id FROM st) SELECT batch_id, count(*) AS results, count(DISTINCT source_id) AS sources, count(*) FILTER (match_status = 'AUTO_MATCHED') AS auto_matched, count(*) FILTER (match_status = 'REVIEW_NEEDED') AS review_needed, count(*) FILTER (match_status = 'NO_MATCH') AS no_match FROM bb GROUP BY batch_id")
def batch_summaries(spark, sf_dir):
    """Counters per batch."""
    batch = F.concat(F.lit("batch-"), (F.substring("source_id", 5, 20).cast("long") % 7).cast("string"))
    rows = stored(spark, sf_dir).withColumns({"batch_id": batch, "created_at": F.lit(0)})
    return results.batch_summaries(rows).drop("last_created")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1")
def latest_decision(spark, sf_dir):
    """The last event of each user and type."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return review.latest(events, ["user_id", "event_type"], tie="event_id").select("user_id", "event_type", "event_id", "value")


# Audit trail over the events: types in turn stand for actions.
AUDIT = "au AS (SELECT event_id AS id, 'batch-' || (user_id % 3) AS batch_id, 'src-' || user_id AS source_id, 'dest-' || (event_id % 11) AS dest_id, ['CONFIRM', 'REJECT', 'OVERRIDE', 'VIEW'][1 + event_id % 4] AS action, ['CONFIRMED', 'REJECTED', 'REVIEW_NEEDED'][1 + event_id % 3] AS new_status, 'REVIEW_NEEDED' AS previous_status, (event_id * 37 % 101) / 100.0::DOUBLE AS score, ts FROM events)"
LABELS = "la AS (SELECT *, CASE action WHEN 'CONFIRM' THEN 1 WHEN 'REJECT' THEN 0 WHEN 'OVERRIDE' THEN CASE new_status WHEN 'CONFIRMED' THEN 1 WHEN 'REJECTED' THEN 0 END END AS is_match FROM au)"
OBSERVED = f"{AUDIT}, {LABELS}, ob AS (SELECT batch_id, source_id, dest_id, score, is_match, previous_status FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, source_id, dest_id ORDER BY ts DESC, id) AS n FROM la WHERE is_match IS NOT NULL) WHERE n = 1)"


def audit_trail(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pick = lambda items, n: F.element_at(F.array(*map(F.lit, items)), (1 + F.col("event_id") % n).cast("int"))
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return e.select(
        F.col("event_id").alias("id"), text("batch-", F.col("user_id") % 3).alias("batch_id"), text("src-", F.col("user_id")).alias("source_id"), text("dest-", F.col("event_id") % 11).alias("dest_id"),
        pick(["CONFIRM", "REJECT", "OVERRIDE", "VIEW"], 4).alias("action"), pick(["CONFIRMED", "REJECTED", "REVIEW_NEEDED"], 3).alias("new_status"), F.lit("REVIEW_NEEDED").alias("previous_status"),
        ((F.col("event_id") * 37 % 101) / 100.0).alias("confidence_score"), F.col("user_id").cast("string").alias("user_id"), "ts",
    )


@query(f"WITH {OBSERVED} SELECT batch_id, source_id, dest_id, score, is_match FROM ob")
def observations(spark, sf_dir):
    """Labelled scores from the audit trail."""
    return review.observations(audit_trail(spark, sf_dir)).select("batch_id", "source_id", "dest_id", "score", "is_match")


@query(f"WITH {OBSERVED} SELECT previous_status, count(*) AS n, CAST(sum(is_match) AS BIGINT) AS matches FROM ob GROUP BY previous_status")
def label_statistics(spark, sf_dir):
    return review.label_statistics(review.observations(audit_trail(spark, sf_dir)))


@query(f"WITH {OBSERVED} SELECT batch_id, source_id, dest_id, (row_number() OVER (ORDER BY batch_id, source_id, dest_id) - 1) % 5 = 4 AS held_out FROM ob")
def holdout_split(spark, sf_dir):
    """Every fifth observation is held out."""
    return review.holdout(review.observations(audit_trail(spark, sf_dir))).select("batch_id", "source_id", "dest_id", "held_out")


@query(f"WITH {AUDIT} SELECT id, action FROM au WHERE batch_id = 'batch-1' AND action = 'CONFIRM'")
def audit_filter(spark, sf_dir):
    """Audit rows of a batch and action, newest first."""
    return review.audit_page(audit_trail(spark, sf_dir), batch_id="batch-1", action="CONFIRM").select("id", "action")


ACTED = "a1 AS (SELECT 'src-' || (event_id % 500) AS source_id, ['CONFIRM', 'REJECT', 'UNLINK', 'LOOK'][1 + event_id % 4] AS action, ts, ['CONFIRMED', 'REJECTED', 'REJECTED', NULL][1 + event_id % 4] AS new_status FROM events), a2 AS (SELECT source_id, new_status FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, new_status DESC) AS n FROM a1 WHERE new_status IS NOT NULL) WHERE n = 1)"


@query(f"WITH {STORED}, {ACTED} SELECT source_id, dest_id, coalesce(new_status, match_status) AS match_status FROM st LEFT JOIN a2 USING (source_id) WHERE rank = 1")
def review_actions(spark, sf_dir):
    """First-rank results after the events, taken as review actions."""
    rows = stored(spark, sf_dir).filter("rank = 1").withColumns({"batch_id": F.lit("b"), "id": F.col("source_id")})
    kind = F.element_at(F.array(*map(F.lit, ["CONFIRM", "REJECT", "UNLINK", "LOOK"])), (1 + F.col("event_id") % 4).cast("int"))
    done = table(spark, sf_dir, "events").select(F.lit("b").alias("batch_id"), F.concat(F.lit("src-"), (F.col("event_id") % 500).cast("string")).alias("id"), kind.alias("action"), F.lit("u").alias("user_id"), F.lit("").alias("comments"), "ts")
    return review.act(rows, done)[0].select("source_id", "dest_id", "match_status")


@query("SELECT o_orderkey, 'src-' || (o_custkey) AS source_id, 'dest-' || (o_orderkey % 150) AS dest_id, 'CONFIRMED' AS match_status FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) AND o_orderkey % 150 IN (SELECT s_suppkey FROM supplier)")
def manual_link(spark, sf_dir):
    """Manual links whose records both exist, from orders."""
    ident = lambda c, p: F.concat(F.lit(p), c.cast("string"))
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("batch_id"), ident(F.col("o_custkey"), "src-").alias("source_id"), ident(F.col("o_orderkey") % 150, "dest-").alias("dest_id"), F.lit(1.0).alias("score"), F.lit("u").alias("user_id"), F.lit("").alias("comments"), F.col("o_orderdate").alias("ts"))
    sources = table(spark, sf_dir, "customer").select(ident(F.col("c_custkey"), "src-").alias("id"))
    dests = table(spark, sf_dir, "supplier").select(ident(F.col("s_suppkey"), "dest-").alias("id"))
    return review.manual_links(links, sources, dests)[0].select(F.col("batch_id").cast("long").alias("o_orderkey"), "source_id", "dest_id", "match_status")


PROBS = "SELECT doc_id, ((doc_id * 37) % 101) / 100.0::DOUBLE AS p, quality AS y FROM labels"


def predictions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", ((F.col("doc_id") * 37 % 101) / 100.0).alias("p"), F.col("quality").alias("y"))


@query(f"SELECT avg((p - y) * (p - y)) AS brier FROM ({PROBS})")
def brier(spark, sf_dir):
    return calibration.brier(predictions(spark, sf_dir), F.col("p"), F.col("y"))


@query(f"WITH b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM ({PROBS}) GROUP BY 1) SELECT sum(n * abs(mp - my)) / sum(n) AS ece FROM b")
def ece(spark, sf_dir):
    return calibration.expected_calibration_error(predictions(spark, sf_dir), F.col("p"), F.col("y"))


@query(f"""WITH s AS (SELECT round(p, 4) AS s, sum(y)::DOUBLE AS m, count(*)::DOUBLE AS n FROM ({PROBS}) GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY s) AS i FROM s),
    a AS (SELECT x.i AS j, y.i AS k, sum(z.m) / sum(z.n) AS mean FROM i x JOIN i y ON y.i >= x.i JOIN i z ON z.i BETWEEN x.i AND y.i GROUP BY ALL),
    l AS (SELECT i.i, a.j, min(a.mean) AS low FROM i JOIN a ON a.j <= i.i AND a.k >= i.i GROUP BY ALL), g AS (SELECT i, max(low) AS g FROM l GROUP BY i),
    v AS (SELECT i, g, min(i) OVER (PARTITION BY round(g, 9)) AS first FROM g),
    b AS (SELECT g AS prob, s AS x FROM v JOIN i USING (i) JOIN a ON a.j = v.first AND a.k = v.i WHERE abs(a.mean - g) <= 1e-9), e AS (SELECT *, lag(x) OVER (ORDER BY x) AS x0, lag(prob) OVER (ORDER BY x) AS p0 FROM b)
    SELECT doc_id, p, y, CASE WHEN x0 IS NULL THEN prob ELSE p0 + (p - x0) * (prob - p0) / (x - x0) END AS calibrated FROM ({PROBS}) q JOIN e ON q.p <= e.x AND (x0 IS NULL OR q.p > x0)""")
def isotonic_fit(spark, sf_dir):
    """Calibrated probability of every labelled document under the fitted calibrator."""
    rows = predictions(spark, sf_dir)
    model = calibration.fit(rows, "p", "y", isotonic_from=1)
    return rows.withColumn("calibrated", model.apply(F.col("p")))


@query("SELECT c_custkey, c_mktsegment || ' ' || c_name AS raw_name, 'SRC-' || CASE WHEN c_custkey < 1000 THEN lpad(CAST(c_custkey AS VARCHAR), 4, '0') ELSE CAST(c_custkey AS VARCHAR) END AS reference_id, 'src-' || c_custkey AS id FROM customer")
def build_records(spark, sf_dir):
    """Source records from two name columns, without a business key."""
    rows = table(spark, sf_dir, "customer").withColumn("ordinal", F.col("c_custkey"))
    built = records.sources(rows, ColumnMapping(source_names=("c_mktsegment", "missing", "c_name")))
    return built.select(F.col("ordinal").alias("c_custkey"), "raw_name", "reference_id", "id")


@query("SELECT count(*) AS rows, min(n) AS least, max(n) AS most, count(DISTINCT n) AS distinct_ordinals FROM (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem)")
def ordinals(spark, sf_dir):
    """Numbers without gaps for all line items."""
    rows = records.with_ordinal(table(spark, sf_dir, "lineitem").select("l_orderkey"))
    return rows.agg(F.count("*").alias("rows"), F.min("ordinal").alias("least"), F.max("ordinal").alias("most"), F.count_distinct("ordinal").alias("distinct_ordinals"))


def part_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Parts as two inputs: name then brand, and brand then name."""
    part = table(spark, sf_dir, "part").withColumn("ordinal", F.col("p_partkey"))
    return part.select("ordinal", F.concat_ws(" ", "p_name", "p_brand").alias("name")), part.select("ordinal", F.concat_ws(" ", "p_brand", "p_name").alias("name"))


@query()
def match_parts(spark, sf_dir):
    """A whole run: parts against parts with transposed names."""
    run = engine.match(*part_inputs(spark, sf_dir))
    return run.results.select("source_id", "dest_id", "confidence_score", "name_score", "rank", "match_status", "decision_note")


@query()
def match_conversations(spark, sf_dir):
    """A many-to-many run: what users say first against what assistants answer first."""
    turns = table(spark, sf_dir, "conversations")
    side = lambda role: turns.filter(F.col("role") == role).groupBy("conv_id").agg(F.min_by("text", "turn").alias("name")).withColumn("ordinal", F.col("conv_id") + 1)
    config = MatchConfig(assignment_strategy="ALL_CANDIDATES", review_threshold=0.5, max_candidates_per_src=10)
    run = engine.match(side("user"), side("assistant"), config)
    return run.results.select("source_id", "dest_id", "confidence_score", "rank", "match_status")


@query()
def match_labelled(spark, sf_dir):
    """A whole run over the labelled corpus, with as many pairs as there are parts."""
    left, right, _ = labelled.inputs(spark, table(spark, sf_dir, "part").count())
    return engine.match(left, right).results.select("source_id", "dest_id", "confidence_score", "cross_script", "rank", "match_status", "decision_note")


@query()
def quality_labelled(spark, sf_dir):
    """Precision, recall, F1 and top-1 accuracy of that run."""
    left, right, truth = labelled.inputs(spark, table(spark, sf_dir, "part").count())
    return evaluation.quality(engine.match(left, right).results, truth)


@query(f"""{BLOCKS}, c AS (SELECT source_id, least(count(*), 50) AS n FROM h GROUP BY source_id), o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS t FROM c)
    SELECT max(n) FILTER (i = floor(t * 0.5)) AS median, max(n) FILTER (i = floor(t * 0.95)) AS p95, max(n) AS max FROM o""")
def candidate_profile(spark, sf_dir):
    """Median, 95th percentile and maximum of the candidates per source."""
    s, d = part_names(spark, sf_dir)
    return evaluation.candidate_profile(blocking.candidates(s, d, d.count()))


@query(f"""WITH p AS ({PAIRS}), j AS (SELECT a, b, jaro_similarity(a, b) AS jaro, CASE WHEN substr(a, 1, 1) <> substr(b, 1, 1) THEN 0 WHEN substr(a, 1, 2) <> substr(b, 1, 2) THEN 1 WHEN substr(a, 1, 3) <> substr(b, 1, 3) THEN 2 WHEN substr(a, 1, 4) <> substr(b, 1, 4) THEN 3 ELSE 4 END AS same FROM p)
    SELECT a, b, jaro + same * 0.1::DOUBLE * (1 - jaro) AS similarity FROM j""")
def jaro_winkler(spark, sf_dir):
    """Jaro-Winkler similarity of the text pairs."""
    return text_pairs(spark, sf_dir).withColumn("similarity", udfs.jaro_winkler(F.col("a"), F.col("b")))


@query()
def romanized_names(spark, sf_dir):
    """Thai names of the labelled corpus with their spoken forms and parties."""
    left, _, _ = labelled.inputs(spark, table(spark, sf_dir, "part").count())
    name = F.col("customer_name")
    return left.select("ordinal", "customer_name", udfs.romanize(name).alias("romanized"), udfs.skeleton(udfs.romanize(name)).alias("skeleton"), udfs.phonetic_form(name).alias("phonetic_form"), udfs.split_parties(name).alias("parties"))


JOBS = "SELECT CAST(o_custkey AS VARCHAR) AS batch_id, max(o_orderdate) AS started_at, count(*) AS results FROM orders GROUP BY 1"


@query(f"SELECT batch_id, results FROM ({JOBS}) ORDER BY started_at DESC, batch_id DESC LIMIT 200 OFFSET 40")
def jobs_page(spark, sf_dir):
    """A page of runs, the latest first; customers' orders stand for the results of a run."""
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("batch_id"))
    runs = runs.agg(F.max("o_orderdate").alias("started_at"), F.count("*").alias("results"))
    return results.jobs_page(runs, 500, 40).select("batch_id", "results")


@query(f"WITH {AUDIT} SELECT CAST(id AS VARCHAR) AS id, batch_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, action, printf('%.4f', score) AS score FROM au WHERE batch_id = 'batch-1'")
def export_audit(spark, sf_dir):
    """Rows of the audit file of a batch."""
    rows = review.export_audit(audit_trail(spark, sf_dir).withColumn("review_comments", F.lit("")), "batch-1")
    return rows.select(F.col("Audit Log ID").alias("id"), F.col("Batch ID").alias("batch_id"), F.col("Timestamp").alias("ts"), F.col("Action").alias("action"), F.col("Confidence Score").alias("score"))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer ORDER BY c_nationkey, c_custkey LIMIT 500 OFFSET 300")
def ordered_page(spark, sf_dir):
    """A page of a connector's rows in the order that is asked for."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return connectors.page(rows, connectors.total_order(rows, "c_nationkey, c_custkey"), 500, 300)


@query(f"WITH {GREEDY} SELECT source_id, dest_id, total_score AS confidence_score, match_status, decision_note FROM g")
def settled_stream(spark, sf_dir):
    """One source per destination over the results of seven micro-batches, each settled by itself before."""
    config = MatchConfig()
    rows = decision.decided(decision.ranked(scored_pairs(spark, sf_dir), config), config)
    part = F.substring("source_id", 5, 20).cast("long") % 7
    each = [decision.greedy(rows.filter(part == i), config) for i in range(7)]
    stored_rows = reduce(DataFrame.unionByName, each).withColumnRenamed("total_score", "confidence_score")
    return incremental.settled(stored_rows, config).select("source_id", "dest_id", "confidence_score", "match_status", "decision_note")


flagship = match_parts
