"""Column expressions of the scalar functions that Spark can express by itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import REF_CODE


def round4(x: Column) -> Column:
    """Half up on the binary product, as scores are rounded; for numbers from 0 on."""
    return F.floor(x * 10000 + 0.5) / 10000


def fixed(x: Column, digits: int) -> Column:
    """A number from 0 to 1,000 with at most four decimals, rounded from its exact binary value, ties to even."""
    scale, x = 10**digits, x.cast("double")
    # two parts of the number whose products with the scale lose no bit
    high = F.floor(x * F.lit(float(1 << 26))) / F.lit(float(1 << 26))
    low = F.floor(x * scale)
    beyond = (high * scale - (low + 0.5)) + (x - high) * scale
    n = low + F.when(beyond > 0, 1).when(beyond == 0, low % 2).otherwise(0)
    if not digits:
        return n.cast("string")
    return F.concat(F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"))


def text_value(c: Column) -> Column:
    """A value as trimmed text, empty if missing."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def composite_name(columns: list[Column]) -> Column:
    """All values that are not empty, joined by spaces."""
    return F.concat_ws(" ", *(F.nullif(text_value(c), F.lit("")) for c in columns))


def contains_thai(c: Column) -> Column:
    return c.rlike(r"[\x{0E00}-\x{0E7F}]")


def strip_ref_code(c: Column) -> Column:
    """Without a trailing reference code; a text that is nothing else stays."""
    short = F.trim(F.regexp_replace(c, REF_CODE, ""))
    return F.when(short == "", F.trim(c)).otherwise(short)


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?<![0-9A-Za-z_])[0-9]+(?![0-9A-Za-z_])"), F.lit(0))


def clean_ascii(c: Column) -> Column:
    """Lower case, no reference code, anything but letters, digits and Thai to single spaces."""
    text = strip_ref_code(F.lower(F.trim(c)))
    return F.trim(F.regexp_replace(text, r"[^a-zA-Z0-9\x{0E00}-\x{0E7F}]+", " "))


def trigrams(c: Column) -> Column:
    """All trigrams of the padded text, with repeats: one more than it has characters."""
    padded = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
    # a character is found at once in an array, in a text only from its start
    return bound(F.split(padded, ""), lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 3), lambda i: F.concat(F.get(x, i), F.get(x, i + 1), F.get(x, i + 2))))


def tagged(items: Column) -> Column:
    """Items numbered by their occurrence, so that set operations respect repeats."""
    ordered = F.array_sort(items)
    return F.transform(ordered, lambda x, i: F.struct(x.alias("x"), (i - F.array_position(ordered, x).cast("int")).alias("n")))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the multisets of trigrams."""
    x, y = trigrams(a), trigrams(b)
    common = F.size(F.array_intersect(tagged(x), tagged(y)))
    return common / (F.size(x) + F.size(y) - common)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def number_mismatch(a: Column, b: Column) -> Column:
    """Both sides have numbers and the sets differ."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.array_sort(F.array_distinct(a)) != F.array_sort(F.array_distinct(b)))


def idf_weight(df: Column, n: Column) -> Column:
    """Normalised inverse document frequency in 0 to 1; 1 for an unseen token or an empty corpus."""
    raw = F.ln(1 + n / (1 + df)) / F.ln(1 + n)
    return F.when((n == 0) | F.coalesce(df, F.lit(0)).eqNullSafe(F.lit(0)), F.lit(1.0)).otherwise(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


def date_score(a: Column, b: Column, tolerance: int) -> Column:
    """Decay with the days between; 0 beyond a positive tolerance; 1 if a date is missing."""
    days = F.abs(F.datediff(a, b))
    score = round4(F.exp(-0.05 * days))
    if tolerance > 0:
        score = F.when(days > tolerance, F.lit(0.0)).otherwise(score)
    return F.coalesce(score, F.lit(1.0))


def token_diff(tokens: Column, others: Column) -> Column:
    """Tokens with whether any other token contains them or is contained in them."""
    near = lambda t: F.exists(others, lambda o: o.contains(t) | t.contains(o))
    return F.transform(tokens, lambda t: F.struct(t.alias("token"), near(t).alias("matched")))


# The layouts of dates and of a time after them.
_TIME = r"\s+\d{1,2}:\d{2}(:\d{2})?(\.\d+)?\s*(Z|[+-]\d{2}:?\d{2})?$"
_ISO = r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:\d{2})|[ ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?)?$"
_SLASHED = r"^\d{4}/\d{2}/\d{2}$"
_COMPACT = r"^\d{8}$"
_NAMED = r"(?i)^\d{1,2} (jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d{4}$"
_DAY_MONTH = r"^\s*\d+\s*([/-])\s*\d+\s*\1\s*\d+\s*$"
_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_date(c: Column, calendar: str = "AUTO", leap_fix: bool = True) -> Column:
    """A date from the usual spellings, null if none fits.

    Thai digits count as digits. Exact layouts come first, then day/month/year with month/day/year as the
    second reading. Years from 2400 on are Buddhist unless the calendar is CE; two digits mean 20yy up to
    69, else 19yy, or 25yy in BE. With ``leap_fix`` the day is checked in the converted year.

    A text's shape decides its layout, so at most three readings are looked at.
    """
    calendar = calendar.upper()
    number = lambda text: text.try_cast("int")

    def era(year: Column) -> Column:
        return year if calendar == "CE" else F.when(year >= 2400, year - 543).otherwise(year)

    def valid(r: Column) -> Column:
        """Whether the day exists in the year that is meant (as written, without the fix)."""
        year, month, day = r["y"], r["m"], r["d"]
        fits = year.between(1, 9999) & month.between(1, 12) & day.between(1, 31)
        length = F.dayofmonth(F.last_day(F.make_date(era(year) if leap_fix else year, F.when(fits, month), F.lit(1))))
        return F.coalesce(fits & (day <= length), F.lit(False))

    def reading(year: Column, month: Column, day: Column) -> Column:
        return F.struct(year.cast("int").alias("y"), month.cast("int").alias("m"), day.cast("int").alias("d"))

    def at(text: Column, month: int, day: int) -> Column:
        return reading(number(F.substring(text, 1, 4)), number(F.substring(text, month, 2)), number(F.substring(text, day, 2)))

    def spelled(parts: Column) -> Column:
        month = F.coalesce(*(F.when(parts[1].isin(n, n[:3]), F.lit(i)) for i, n in enumerate(_MONTHS, 1)))
        return reading(number(parts[2]), month, number(parts[0]))

    def whole(text: Column) -> Column:
        shapes = F.when(text.rlike(_ISO) | text.rlike(_SLASHED), at(text, 6, 9)).when(text.rlike(_COMPACT), at(text, 5, 7))
        return shapes.when(text.rlike(_NAMED), bound(F.split(F.lower(text), " "), spelled))

    def either(parts: Column) -> Column:
        """Day first and month first."""
        x, y, z = (number(F.get(parts, F.lit(i))) for i in range(3))
        two = F.lit(2500) + z if calendar == "BE" else z + F.when(z <= 69, 2000).otherwise(1900)
        year = F.when(F.char_length(F.get(parts, F.lit(2))) <= 2, two).otherwise(z)
        return F.array(reading(year, y, x), reading(year, x, y))

    def first(text: Column) -> Column:
        bare = F.regexp_replace(text, _TIME, "")
        split = F.when(bare.rlike(_DAY_MONTH), F.split(F.regexp_replace(bare, r"\s+", ""), "[/-]"))
        readings = F.concat(F.array(whole(text)), bound(split, either))
        return F.get(F.filter(readings, valid), F.lit(0))

    text = F.translate(F.trim(c), "๐๑๒๓๔๕๖๗๘๙", "0123456789")
    return bound(bound(text, first), lambda r: F.date_add(F.make_date(era(r["y"]), r["m"], F.lit(1)), r["d"] - 1))


def equal_fold(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def leading_number(c: Column) -> Column:
    """The longest number at the start of a text, null if there is none."""
    return F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def numeric_delta(a: Column, b: Column) -> Column:
    """1 for equal numbers, 0.9 within a hundredth of the larger one, else 0, also if one is no number."""
    x, y = leading_number(a), leading_number(b)
    diff = F.abs(x - y)
    return F.coalesce(F.when(diff == 0, 1.0).when(diff <= 0.01 * F.greatest(x, y), 0.9).otherwise(0.0), F.lit(0.0))
