"""A labelled corpus of name pairs, built from a seed: about three matches to two mismatches, by category."""

from __future__ import annotations

import datetime
import itertools
import random
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..llm.common import stash

BASE_DATE = datetime.date(2026, 8, 15)

_THAI_FIRST = "สมชาย สมศักดิ์ วิชัย ประเสริฐ สุชาติ อารียา กัลยา ศิริพร ณัฐพล ธนากร ภัทรา มานะ จันทร์เพ็ญ พิมพ์ใจ อนันต์ กิตติ".split()
_THAI_LAST = "ใจดี สุขสันต์ เข็มกลัด รัตแมด ทองบุญ พลับเจริญสุข บุตรอินทร์ แสงทอง ศรีสุข วงศ์ใหญ่ บุญมี ชูชีพ".split()
_ROMAN = {"สมชาย": "Somchai", "วิชัย": "Wichai", "สุชาติ": "Suchat", "ประเสริฐ": "Prasert", "มานะ": "Mana", "กิตติ": "Kitti", "อนันต์": "Anan", "ธนากร": "Thanakon"}
_ROMAN_LAST = {"ใจดี": "Chaidi", "แสงทอง": "Saengthong", "บุญมี": "Bunmi", "ศรีสุข": "Sisuk", "ทองบุญ": "Thongbun"}
_FIRST = "James Mary John Linda Robert Susan Michael Karen David Nancy Daniel Helen Thomas Laura Peter Alice".split()
_LAST = "Smith Johnson Brown Garcia Miller Davis Wilson Taylor Moore Jackson Harris Clark Lewis Walker".split()
_CORE = "สยามพารากอน มาทวี เสนาดีเวลลอป ทรัพย์ทวี เจริญกิจ รุ่งเรืองชัย บางกอกเทรด นครหลวงทอง อันดามันซี ล้านนาไหม".split()
_GENERIC = "เทคโนโลยี กรุ๊ป การค้า บริการ โซลูชั่น".split()
_VARIANTS = [("ศิริ", "สิริ"), ("ณัฐ", "นัฐ"), ("ธนา", "ทนา"), ("ภัทร", "พัทร"), ("พงษ์", "พงศ์")]

Pair = tuple[str, str]


def _categories(rng: random.Random, tag: Callable[[], str]) -> dict[str, tuple[bool, Callable[[], Pair]]]:
    """Category to whether its pairs match and how one is made. ``tag`` gives a syllable that makes names rare."""
    thai = lambda: (rng.choice(_THAI_FIRST), rng.choice(_THAI_LAST) + tag())
    latin = lambda: (rng.choice(_FIRST), rng.choice(_LAST) + tag().translate(_TAG_LATIN))

    def thai_title() -> Pair:
        f, s = thai()
        return f"นาย{f} {s}", f"คุณ {f} {s}"

    def company() -> Pair:
        c = rng.choice(_CORE) + tag()
        return f"บริษัท {c} จำกัด", f"บจก. {c}"

    def english() -> Pair:
        f, s = latin()
        return f"Mr. {f} {s}", f"{s} {f}"

    def spelled() -> Pair:
        a, b = rng.choice(_VARIANTS)
        s = rng.choice(_THAI_LAST) + tag()
        return f"{a} {s}", f"{b} {s}"

    def across() -> Pair:
        f, s = rng.choice(sorted(_ROMAN)), rng.choice(sorted(_ROMAN_LAST))
        return f"{f} {s}", f"{_ROMAN[f]} {_ROMAN_LAST[s]}"

    def branch() -> Pair:
        c = rng.choice(_CORE) + tag()
        i, j = rng.sample(range(1, 99), 2)
        return f"บริษัท {c} จำกัด (สาขาที่ {i})", f"บริษัท {c} จำกัด (สาขาที่ {j})"

    def same_surname() -> Pair:
        (f, s), g = latin(), rng.choice(_FIRST)
        return f"{f} {s}", f"{g if g != f else 'Zoe'} {s}"

    def generic() -> Pair:
        a, b = rng.sample(_CORE, 2)
        g = rng.choice(_GENERIC)
        return f"บริษัท {a}{tag()} {g} จำกัด", f"บริษัท {b}{tag()} {g} จำกัด"

    def crossed() -> Pair:
        f, s = latin()
        g, t = latin()
        return f"{f} {s}", f"{t} {g}"

    return {
        "THAI_PERSONAL_TITLE": (True, thai_title), "THAI_CORPORATE_SUFFIX": (True, company), "ENGLISH_PERSONAL_VARIATION": (True, english),
        "THAI_VARIANT_SPELLING": (True, spelled), "BILINGUAL_OUT_OF_DICT": (True, across), "NON_MATCH_BRANCH_MISMATCH": (False, branch),
        "NEG_SAME_SURNAME_DIFF_PERSON": (False, same_surname), "NEG_GENERIC_TOKEN_OVERLAP": (False, generic), "NEG_DIFFERENT_PEOPLE": (False, crossed),
    }


_SYLLABLES = "กา นี โต มู เล พา ซู ดี ฮา โม".split()
_TAG_LATIN = str.maketrans({"ก": "k", "า": "a", "น": "n", "ี": "i", "โ": "o", "ต": "t", "ม": "m", "ู": "u", "เ": "e", "ล": "l", "พ": "p", "ซ": "s", "ด": "d", "ฮ": "h"})


#: Pairs that one run of random numbers makes; the first ones come from the seed itself, each further block from a seed of its own.
BLOCK = 1 << 16

Labelled = tuple[str, str, bool, str, datetime.date, datetime.date]


def block(number: int, count: int, seed: int, size: int) -> Iterator[Labelled]:
    """The pairs of a block of ``size`` pairs in a corpus of ``count``."""
    rng = random.Random(seed if number == 0 else f"{seed} {number}")
    tag = lambda: "".join(rng.choice(_SYLLABLES) for _ in range(2))
    made = _categories(rng, tag)
    sides = {kind: [k for k, (m, _) in made.items() if m == kind] for kind in (True, False)}
    for i in range(number * size, min(count, (number + 1) * size)):
        kind = i % 5 < 3
        category = sides[kind][i // 5 % len(sides[kind])]
        a, b = made[category][1]()
        day = BASE_DATE - datetime.timedelta(days=rng.randrange(365))
        yield a, b, kind, category, day, day + datetime.timedelta(days=rng.randrange(4))


def pairs(count: int, seed: int = 42) -> list[Labelled]:
    """source, destination, is_match, category and both dates of ``count`` pairs."""
    return [row for number in range(-(-count // BLOCK)) for row in block(number, count, seed, BLOCK)]


def inputs(spark: SparkSession, count: int, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Source rows, destination rows and the true pairs (source_id, dest_id, category) of a labelled corpus, made in tasks and stashed."""
    size = BLOCK
    numbers = -(-count // size)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                rows = block(number, count, seed, size)
                at = number * size
                while part := list(itertools.islice(rows, 10_000)):
                    ordinals = pa.array(range(at + 1, at + 1 + len(part)), pa.int64())
                    at += len(part)
                    kinds = (pa.string(), pa.string(), pa.bool_(), pa.string(), pa.date32(), pa.date32())
                    columns = [pa.array(v, kind) for v, kind in zip(zip(*part, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([ordinals, *columns], ["ordinal", "source", "dest", "is_match", "category", "source_date", "dest_date"])

    schema = "ordinal long, source string, dest string, is_match boolean, category string, source_date date, dest_date date"
    rows = stash(spark.range(0, numbers, 1, max(1, numbers)).mapInArrow(made, schema), "labelled")
    left = rows.select("ordinal", F.col("source").alias("customer_name"), F.col("source_date").alias("transaction_date"))
    right = rows.select("ordinal", F.col("dest").alias("customer_name"), F.col("dest_date").alias("transaction_date"))
    ident = lambda side: F.concat(F.lit(f"{side}-"), F.col("ordinal").cast("string"))
    return left, right, rows.filter("is_match").select(ident("src").alias("source_id"), ident("dest").alias("dest_id"), "category")
