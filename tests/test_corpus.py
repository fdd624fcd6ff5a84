"""A run over the labelled corpus, the dictionary, and streaming."""

import pytest
from pyspark.sql import functions as F

from linkloom.functions.dictionary import Dictionary, replace_aliases
from linkloom.functions.names import normalize
from linkloom.functions.udfs import register
from linkloom.operators import evaluation
from linkloom.plans import engine, labelled
from linkloom.streaming.incremental import run_stream


def test_labelled_corpus(spark):
    left, right, truth = labelled.inputs(spark, 120)
    assert labelled.pairs(40) == labelled.pairs(40)
    run = engine.match(left, right)
    q = evaluation.quality(run.results, truth).first()
    assert q["precision"] >= 0.85 and q["recall"] >= 0.3 and q["most_per_dest_id"] == q["most_per_source_id"] == 1
    profile = evaluation.candidate_profile(run.candidates).first()
    assert profile["median"] <= profile["p95"] <= profile["max"] <= 50
    run.release()


def test_dictionary(spark):
    d = Dictionary()
    d.upsert("KTB", "Krung Thai Bank")
    assert d.delete("scb") and not d.delete("unknown")
    again = Dictionary.from_frame(d.to_frame(spark))
    assert again.entries() == d.entries() and normalize("ktb", d.entries()).cleaned == "krung thai bank" and normalize("scb", d.entries()).cleaned == "scb"
    row = spark.range(1).select(replace_aliases(F.array(F.lit("KTB"), F.lit("x")), d.entries()).alias("t")).first()
    assert row["t"] == ["krung", "thai", "bank", "x"]
    with pytest.raises(ValueError):
        d.upsert(" ", "x")


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("SELECT jaro_winkler('aXYZ', 'aPQR') AS j, romanize_thai('วิชัย') AS t, split_parties('a b,c d') AS p").first()
    assert (round(r["j"], 4), r["t"], r["p"]) == (0.55, "wichai", ["a b", "c d"])


def test_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, "Siam Paragon"), (2, "Nobody")], "ordinal long, name string").coalesce(1).write.parquet(folder)
    dest = spark.createDataFrame([(1, "Siam Paragon")], "ordinal long, name string")
    got = []
    stream = spark.readStream.schema("ordinal long, name string").parquet(folder)
    run_stream(stream, dest, lambda rows, n: got.extend((r["source_id"], r["match_status"]) for r in rows.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(got) == [("src-1", "AUTO_MATCHED"), ("src-2", "NO_MATCH")]
