"""Ingest, total orders, identifiers, model store, counters of an action, results settled across batches."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.config import ColumnMapping
from linkloom.operators import calibration, results, review
from linkloom.plans import engine, ingest
from linkloom.sources import Connection, connectors


def rows(*names):
    return Connection(rows=tuple({"name": n, "k": i} for i, n in enumerate(names)))


def test_ingest_and_match(spark, tmp_path, monkeypatch):
    monkeypatch.setenv(connectors.MAX_INGEST_VARIABLE, "3")
    told = ingest.ingest(spark, rows("Anna Smith", "Bob Jones"), rows("Smith Anna", "Jones Bob", "x", "y"), str(tmp_path), batch_id="b1")
    assert (told["sources_count"], told["destinations_count"], told["sources_truncated"], told["destinations_truncated"]) == (2, 3, False, True) and "cap of 3" in told["warning"]
    ingest.ingest(spark, rows("Zoe"), rows("Zoe"), str(tmp_path), ColumnMapping(), "b2")
    left, right = ingest.dataset(spark, str(tmp_path), "b1")
    assert (left.count(), right.count()) == (2, 3)
    kept, seen = results.observed(engine.match_records(left, right).results)
    found = {r["source_id"]: r["match_status"] for r in kept.collect()}
    assert seen.get["rows"] == len(found) == 2 and seen.get["auto_matched"] == sum(s == "AUTO_MATCHED" for s in found.values())
    with pytest.raises(ValueError):
        ingest.ingest(spark, Connection(type="TELNET"), rows("a"), str(tmp_path))
    assert ingest.ingest(spark, Connection(), Connection(), str(tmp_path))["sources_count"] == 0


def test_total_order(spark, monkeypatch):
    df = spark.createDataFrame([(i % 3, i, {"a": 1}) for i in range(20)], "a int, b int, m map<string,int>")
    assert connectors.total_order(df) == ["a", "b"] and connectors.total_order(df, key=("b",)) == ["b"] and connectors.total_order(df, " b , a ") == ["b", "a"]
    for bad in ("b; drop", "a b"):
        with pytest.raises(ValueError):
            connectors.total_order(df, bad)
    with pytest.raises(ValueError):
        connectors.total_order(df.select("m"))
    pages = [r["b"] for k in range(0, 20, 6) for r in connectors.page(df, ["a", "b"], 6, k).collect()]
    assert pages == sorted(range(20), key=lambda i: (i % 3, i))
    first, more = connectors.capped(df, 7, ["b"])
    assert more and sorted(r["b"] for r in first.collect()) == list(range(7)) and not connectors.capped(df, 20)[1]
    monkeypatch.setenv(connectors.MAX_INGEST_VARIABLE, "-4")
    assert connectors.max_ingest() == connectors.MAX_INGEST


def test_plain_ids(spark):
    raw = bytes(range(12))
    df = spark.createDataFrame([((raw,), raw, [((raw,), 1)], None)], "ref struct<oid:binary>, _id binary, items array<struct<_id:struct<oid:binary>,n:int>>, other struct<oid:string>")
    row = connectors.plain_ids(df).first()
    assert (row["ref"], row["_id"], row["items"][0]["_id"], row["items"][0]["n"], row["other"]) == (raw.hex(), raw.hex(), raw.hex(), 1, None)


def test_model_store(spark, tmp_path):
    path = str(tmp_path / "models")
    first = calibration.save_model(spark, path, calibration.Platt(-3.0, 1.0), fitted_by="a", observations=30)
    second = calibration.save_model(spark, path, calibration.Isotonic((0.1, 0.9), (0.2, 0.8)), fitted_by="b")
    calibration.save_model(spark, path, calibration.Identity(), active=False)
    stored = calibration.models(spark, path)
    assert [r["active"] for r in stored.collect()] == [False, True, False] and {first, second} <= {r["model_id"] for r in stored.collect()}
    row = calibration.active(spark.read.parquet(path)).first()
    assert row["model_id"] == second and calibration.from_json(row["model"]).scores == (0.1, 0.9) and json.loads(row["model"])["type"] == "isotonic"
    assert calibration.models(spark, path, limit=1, offset=2).first()["model_id"] == first


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_isotonic_blocks_by_search(spark, n):
    xs = np.linspace(0.1, 0.9, n)
    model = calibration.Isotonic(tuple(xs.tolist()), tuple(np.sort(np.random.default_rng(n).random(n)).tolist()))
    asked = [-1.0, 0.0, *xs[:40].tolist(), *(xs[:40] + 1e-4).tolist(), 0.9, 2.0]
    got = spark.createDataFrame([(x,) for x in asked] + [(None,)], "x double").select("x", model.apply(F.col("x")).alias("p")).collect()
    assert all(r["p"] is None if r["x"] is None else abs(r["p"] - np.interp(r["x"], model.scores, model.probs)) < 1e-12 for r in got)


def test_audit_file(spark):
    audit = spark.createDataFrame([("1", "b", "u", "CONFIRM", "REVIEW_NEEDED", "CONFIRMED", 0.91755, None), ("2", "c", "u", "REJECT", None, "REJECTED", None, "no")], "id string, batch_id string, user_id string, action string, previous_status string, new_status string, confidence_score double, review_comments string")
    out = review.export_audit(audit.withColumn("ts", F.lit("2024-05-06 07:08:09").cast("timestamp")))
    assert out.columns == list(review.AUDIT_EXPORT.values())
    assert [tuple(r) for r in out.collect()] == [
        ("2", "c", "2024-05-06T07:08:09Z", "u", "REJECT", "", "REJECTED", "0.0000", "no"), ("1", "b", "2024-05-06T07:08:09Z", "u", "CONFIRM", "REVIEW_NEEDED", "CONFIRMED", f"{0.91755:.4f}", ""),
    ]
