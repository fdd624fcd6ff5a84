"""Operators on small inputs."""

import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom import config
from linkloom.functions import columns as C
from linkloom.operators import blocking, calibration, evaluation, records, results, review
from linkloom.plans import catalog, engine
from linkloom.sources import Connection, connectors

DATES = [
    ("", None), ("not a date", None), ("2023-02-30", None), ("00/00/00", None), ("2023-12-25T15:30:45Z", "2023-12-25"), ("2023-12-25", "2023-12-25"),
    ("2023/12/25", "2023-12-25"), ("20231225", "2023-12-25"), ("25 December 2023", "2023-12-25"), ("25 Dec 2023", "2023-12-25"), ("2569-08-15", "2026-08-15"),
    ("15/08/2569", "2026-08-15"), ("๒๕๖๙-๐๘-๑๕", "2026-08-15"), ("02/01/2006", "2006-01-02"), ("15/03/00", "2000-03-15"), ("15/01/2006", "2006-01-15"),
    ("01/15/2006", "2006-01-15"), ("29/02/2567", "2024-02-29"),
]


def test_dates(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DATES)], "i int, t string")
    found = {r["i"]: r["d"] for r in rows.select("i", C.parse_date(F.col("t")).alias("d")).collect()}
    assert {i: str(d) if d else None for i, d in found.items()} == {i: d for i, (_, d) in enumerate(DATES)}


CSV_PAIRS = [
    ("บริษัท สยามพารากอน ดีเวลลอปเม้นท์ จำกัด", "2026-01-15", "สยามพารากอน ดีเวลลอปเม้นท์ บจก.", "2026-01-15"),
    ("Bangkok Bank Public Company Limited", "2026-01-16", "Bangkok Bank PLC", "2026-01-18"),
    ("John Michael Smith", "2026-02-01", "Smith John Michael", "2026-02-03"),
    ("นางสาว อาริยา สุขสันต์", "2026-02-11", "คุณ อาริยา สุขสันต์", "2026-02-12"),
]


def test_whole_run(spark):
    left = spark.createDataFrame([(i, a, d) for i, (a, d, _, _) in enumerate(CSV_PAIRS, 1)] + [(5, "Nobody Else", None)], "ordinal int, customer_name string, transaction_date string")
    right = spark.createDataFrame([(i, b, d) for i, (_, _, b, d) in enumerate(CSV_PAIRS, 1)], "ordinal int, customer_name string, transaction_date string")
    run = engine.match(left, right)
    found = {r["source_id"]: r for r in run.results.filter("rank <= 1").collect()}
    assert {k: (r["dest_id"], r["match_status"]) for k, r in found.items()} == {
        "src-1": ("dest-1", "AUTO_MATCHED"), "src-2": ("dest-2", "AUTO_MATCHED"), "src-3": ("dest-3", "AUTO_MATCHED"), "src-4": ("dest-4", "AUTO_MATCHED"), "src-5": (None, "NO_MATCH"),
    }
    assert found["src-5"]["decision_note"] == "All blocking candidates scored below review threshold"
    truth = spark.createDataFrame([(f"src-{i}", f"dest-{i}") for i in range(1, 5)], "source_id string, dest_id string")
    q = evaluation.quality(run.results, truth).first()
    assert q["precision"] == q["recall"] == q["f1"] == q["top1"] == 1.0
    assert run.hydrated().filter("source_id = 'src-2'").first()["dest_name"] == "Bangkok Bank PLC"
    run.release()


def test_run_against_nothing(spark):
    left = spark.createDataFrame([("a b",)], "name string")
    assert engine.match(left, left.limit(0)).results.count() == 0
    assert engine.match(left.limit(0), left).results.count() == 0


def test_strategies(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta")], "ordinal int, name string")
    many = engine.match(rows, rows, config.MatchConfig(assignment_strategy="ALL_CANDIDATES")).results.filter("match_status = 'AUTO_MATCHED'").count()
    top = engine.match(rows, rows, config.MatchConfig(assignment_strategy="TOP_1")).results.count()
    assert (many, top) == (4, 2)


def test_config():
    c = config.MatchConfig().merge({"review_threshold": 0.5, "metrics": {"romanized": False}})
    assert c.review_threshold == 0.5 and not c.metrics.romanized and config.MatchConfig(margin_threshold=0).margin_threshold == 0.05
    for bad in ({"nothing": 1}, {"review_threshold": 0.95}, {"assignment_strategy": "X"}, {"auto_match_threshold": 2}):
        with pytest.raises(ValueError):
            config.MatchConfig().merge(bad)


def test_top_k_ties(spark):
    pairs = spark.createDataFrame([("s", f"d{i}", i, 5) for i in range(6)], "source_id string, dest_id string, dest_ordinal long, hits long")
    assert sorted(r["dest_id"] for r in blocking.top_k(pairs, 3).collect()) == ["d0", "d1", "d2"]


def test_connectors(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('reference_id, customer_name ,date\n1,"Smith, John",2024-01-02\n2,สมชาย,\n', encoding="utf-8")
    c = Connection("CSV", path=str(path), options={"root": str(tmp_path)})
    assert [tuple(r) for r in connectors.read(spark, c).collect()] == [("1", "Smith, John", "2024-01-02"), ("2", "สมชาย", None)]
    with pytest.raises(PermissionError):
        connectors.read(spark, Connection("CSV", path="/etc/hostname", options={"root": str(tmp_path)}))
    with pytest.raises(PermissionError):
        connectors.confined(str(path), "")
    inline = connectors.read(spark, Connection("unknown", rows=({"a": 1}, {"a": 2, "b": "x"})))
    assert [tuple(r) for r in inline.collect()] == [("1", None), ("2", "x")]
    assert connectors.capped(inline, 1)[1] and not connectors.capped(inline, 2)[1]
    with pytest.raises(ValueError):
        connectors.identifier("a; drop")


def test_records(spark):
    rows = spark.createDataFrame([(None, " A ", "B"), ("r", None, None)], "reference_id string, first string, customer_name string")
    built = records.sources(rows, config.ColumnMapping(source_names=("first", "customer_name"))).orderBy("ordinal").collect()
    assert [(r["id"], r["reference_id"], r["raw_name"]) for r in built] == [("src-1", "SRC-0001", "A B"), ("src-2", "r", "")]


def test_calibration():
    rng = np.random.default_rng(1)
    s = rng.random(400)
    y = (rng.random(400) < s).astype(int)
    m = calibration.fit_platt(s, y, np.ones(400))
    assert m.a < 0 and calibration.from_json(m.to_json()) == m
    assert calibration.fit_platt(s, y, np.ones(400), stuck=True) == calibration.Platt(0.0, 0.0)
    iso = calibration.fit_isotonic(np.array([1, 2, 3, 4.0]), np.array([1, 0, 1, 2.0]), np.array([1, 1, 2, 2.0]))
    assert list(iso.probs) == sorted(iso.probs) and iso.scores[-1] == 4.0


def test_review_and_pages(spark):
    rows = spark.createDataFrame([("b", "1", "s", "d", "REVIEW_NEEDED", 0.8)], "batch_id string, id string, source_id string, dest_id string, match_status string, confidence_score double")
    ts = datetime.datetime(2024, 1, 1)
    done = spark.createDataFrame([("b", "1", "confirm", "u", "", ts), ("b", "1", "look", "u", "", ts)], "batch_id string, id string, action string, user_id string, comments string, ts timestamp")
    out, audit = review.act(rows, done)
    assert out.first()["match_status"] == "CONFIRMED" and [r["previous_status"] for r in audit.collect()] == ["REVIEW_NEEDED"]
    q = results.ResultsQuery(limit=1000, page=-3, sort="x", direction="DESC").normalized()
    assert (q.limit, q.page, q.sort, q.direction) == (200, 1, "created_at", "desc") and results.total_pages(0, 20) == 1


def test_adjudicate(spark):
    rows = spark.createDataFrame([("Siam Co., Ltd.", "Siam Company Limited", "2024-01-01", "2024-01-01"), ("abc", "xyz", "", "")], "source_name string, dest_name string, source_date string, dest_date string")
    found = {r["source_name"]: (r["verdict"], r["entity_type"]) for r in engine.adjudicate(rows).collect()}
    assert found == {"Siam Co., Ltd.": ("EXACT", "CORPORATE"), "abc": ("MISMATCH", "PERSONAL")}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, folder)
    wanted = con.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(wanted.columns)

    def plain(v):
        return round(v, 9) if isinstance(v, float) else str(v)

    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    theirs = sorted((tuple(plain(v) for v in r) for r in wanted.project(", ".join(columns)).fetchall()), key=str)
    assert mine == theirs


def test_notes_round_the_exact_binary_value(spark):
    from linkloom.functions import columns as C

    values = [0.9175, 0.9185, 0.0625, 0.1875, 0.3125, 0.0005, 0.9995, 1.0, 0.0, 0.12345, 0.50005, 0.00005, 0.00015, 7.0625, 999.9995]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r["x"]: (r["a"], r["b"]) for r in rows.select("x", C.fixed(rows.x, 3).alias("a"), C.fixed(rows.x, 4).alias("b")).collect()}
    assert got == {v: (f"{v:.3f}", f"{v:.4f}") for v in values}


def test_dates_of_every_shape(spark):
    import datetime

    from linkloom.functions import columns as C

    cases = {
        "2023-02-28": (2023, 2, 28), "2023-02-30": None, "2023/12/01": (2023, 12, 1), "20240229": (2024, 2, 29), "29/02/2567": (2024, 2, 29), "3 September 2020": (2020, 9, 3),
        "3 sept 2020": None, "31/12/69": (2069, 12, 31), "31-12-70 23:59": (1970, 12, 31), "12/31/2020": (2020, 12, 31), "31/31/2020": None, "๐๑/๐๒/๒๕๖๖": (2023, 2, 1),
        "0005-13-05": (2005, 5, 13), "1/2-2020": None, "99999999999/1/2": None, "": None,
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: r["d"] for r in rows.select("t", C.parse_date(rows.t).alias("d")).collect()}
    assert got == {t: d and datetime.date(*d) for t, d in cases.items()}
