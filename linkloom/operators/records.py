"""Record building: two inputs of any columns to sources and destinations with identifiers, names and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import ColumnMapping
from ..functions import columns as C

#: Columns whose values make up a name when none of the mapped ones has any.
NAME_FALLBACK = ("customer_name", "name", "raw_name", "company_name", "CustomerName", "full_name", "Name")


def with_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """Rows numbered from 1 in their order, without gaps and without a sort: partition offsets plus place in the partition."""
    seq = F.monotonically_increasing_id()
    rows = df.withColumn("_seq", seq)
    place = F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1))
    part = F.shiftright("_seq", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.withColumn("_part", part).join(sizes, "_part").withColumn(name, F.col("_before") + place + 1).drop("_seq", "_part", "_before")


def name_column(df: DataFrame, mapped: tuple[str, ...]) -> Column:
    """All mapped columns that exist, joined; if they are all empty, those that names are usually in."""
    have = set(df.columns)
    own = [F.col(f"`{c}`") for c in mapped if c in have]
    usual = [F.col(f"`{c}`") for c in NAME_FALLBACK if c in have]
    first = C.composite_name(own) if own else F.lit("")
    return F.when(first != "", first).otherwise(C.composite_name(usual) if usual else F.lit(""))


def _records(df: DataFrame, side: str, key: str, id_prefix: str, key_prefix: str, names, ref: str, date: str, calendar: str, keep: list[str]) -> DataFrame:
    rows = df if "ordinal" in df.columns else with_ordinal(df)
    have = set(df.columns)
    business = C.text_value(F.col(f"`{ref}`")) if ref in have else F.lit("")
    number = F.col("ordinal").cast("string")
    padded = F.when(F.char_length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    day = F.lit(None).cast("date")
    if date in have:
        kind = dict(df.dtypes)[date]
        day = F.col(f"`{date}`").cast("date") if kind in ("date", "timestamp", "timestamp_ntz") else C.parse_date(F.col(f"`{date}`").cast("string"), calendar)
    pairs = [x for c in keep if c in have for x in (F.lit(c), C.text_value(F.col(f"`{c}`")))]
    attributes = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return rows.select(
        F.concat(F.lit(id_prefix), number).alias("id"), F.col("ordinal").cast("long").alias("ordinal"),
        F.when(business != "", business).otherwise(F.concat(F.lit(key_prefix), padded)).alias(key),
        name_column(df, names).alias("raw_name"), day.alias("transaction_date"), attributes.alias("attributes"),
        *([(C.text_value(F.col("`transaction_type`")) if "transaction_type" in have else F.lit("")).alias("transaction_type")] if side == "source" else []),
    )


def sources(df: DataFrame, mapping: ColumnMapping = ColumnMapping()) -> DataFrame:
    """id, ordinal, reference_id, raw_name, transaction_date, attributes, transaction_type. An ordinal column gives the order if there is one."""
    keep = sorted({s.field_src for s in mapping.secondary})
    return _records(df, "source", "reference_id", "src-", "SRC-", mapping.source_names, mapping.source_ref, mapping.source_date, mapping.source_calendar, keep)


def destinations(df: DataFrame, mapping: ColumnMapping = ColumnMapping()) -> DataFrame:
    """id, ordinal, customer_id, raw_name, transaction_date, attributes."""
    keep = sorted({s.field_dest for s in mapping.secondary})
    return _records(df, "dest", "customer_id", "dest-", "DEST-", mapping.dest_names, mapping.dest_ref, mapping.dest_date, mapping.dest_calendar, keep)
