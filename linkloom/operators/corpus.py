"""Corpus statistics: in how many records a token stands, and the weights that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def frequencies(named: DataFrame) -> DataFrame:
    """token, df over records with an array column tokens; a token counts once a record. A column ``of`` says how many records a row stands for."""
    times = F.col("of") if "of" in named.columns else F.lit(1)
    return named.select(F.explode(F.array_distinct("tokens")).alias("token"), times.alias("of")).groupBy("token").agg(F.sum("of").alias("df"))


def weights(frequency: DataFrame, n: int) -> DataFrame:
    """token, df, weight for a corpus of ``n`` records."""
    return frequency.withColumn("weight", C.idf_weight(F.col("df"), F.lit(n)))


def token_weights(records: DataFrame, weighted: DataFrame, key: str = "id", tokens: str = "vocabulary") -> DataFrame:
    """key, weights (token to weight) for the tokens of each record that the corpus has."""
    each = records.select(key, F.explode(tokens).alias("token")).join(weighted.select("token", "weight"), "token")
    return each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "weight"))).alias("weights"))
