"""match_conversations scores whole first turns."""

from linkloom.plans import catalog


def test_differences_after_a_long_equal_start(spark, tmp_path):
    start = "please compare the northern harbour ledger with "
    turns = [(0, 0, "user", start + "copper invoices from winter"), (0, 1, "assistant", start + "copper invoices from winter"),
             (1, 0, "user", start + "velvet curtains ordered yesterday"), (1, 1, "assistant", start + "seventeen wooden elephants painted blue")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    score = {(r["source_id"], r["dest_id"]): r["confidence_score"] for r in catalog.match_conversations(spark, str(tmp_path)).collect()}
    best = max(score.values())
    assert sum(s == best for s in score.values()) == 1, score
