"""Arrow kernels over the plain functions, and their registration for SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import names, similarity, thai

NAME = T.StructType([
    T.StructField("raw", T.StringType()),
    T.StructField("cleaned", T.StringType()),
    T.StructField("sorted_tokens", T.StringType()),
    T.StructField("tokens", T.ArrayType(T.StringType())),
    T.StructField("distinctive_tokens", T.ArrayType(T.StringType())),
    T.StructField("numbers", T.ArrayType(T.StringType())),
    T.StructField("phonetic_key", T.StringType()),
    T.StructField("phonetic_form", T.StringType()),
    T.StructField("romanized", T.StringType()),
])


def normalize(c: Column, aliases: dict[str, str] = names.ALIASES) -> Column:
    """The normalised name as a struct; each distinct name of a batch is worked on once."""

    @F.pandas_udf(NAME)
    def run(raw: pd.Series) -> pd.DataFrame:
        codes, distinct = pd.factorize(raw.fillna(""))
        made = pd.DataFrame([names.normalize(x, aliases) for x in distinct], columns=NAME.names)
        return made.take(codes).reset_index(drop=True)

    return run(c)


def _each(function: Callable, kind: T.DataType):
    """A pandas function of one text that is called once for each distinct value."""

    @F.pandas_udf(kind)
    def run(c: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(c.fillna(""))
        return pd.Series([function(x) for x in distinct], dtype=object).take(codes).reset_index(drop=True)

    return run


several_parties = _each(lambda raw: len(names.split_parties(raw)) > 1, T.BooleanType())
split_parties = _each(names.split_parties, T.ArrayType(T.StringType()))
phonetic_form = _each(thai.phonetic_form, T.StringType())
romanize = _each(thai.romanize, T.StringType())
skeleton = _each(thai.skeleton, T.StringType())


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity.jaro_winkler(x, y) for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype=float)


def register(spark: SparkSession) -> None:
    """Make the kernels callable from SQL."""
    for name, function in (("split_parties", split_parties), ("thai_phonetic_form", phonetic_form), ("romanize_thai", romanize), ("phonetic_skeleton", skeleton), ("jaro_winkler", jaro_winkler)):
        spark.udf.register(name, function)


def _party_tokens(raw: str) -> list[list[str]]:
    """Tokens of every party of a field, and of those that a party splits into again."""
    out, todo = [], [raw]
    while todo:
        field = todo.pop()
        parties = names.split_parties(field)
        if len(parties) > 1:
            out += [names.party_name(p).tokens for p in parties]
            todo += [p for p in parties if p != field]
    return out


party_tokens = _each(_party_tokens, T.ArrayType(T.ArrayType(T.StringType())))
