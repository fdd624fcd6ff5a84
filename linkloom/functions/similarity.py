"""String similarities and the composite score of a pair of names."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np

from . import batched, thai
from .names import Name, bilingual, in_dictionary, parties_of, party_name


def round4(x: float) -> float:
    """Half up on the binary product, for numbers from 0 on."""
    return math.floor(x * 10_000 + 0.5) / 10_000


@lru_cache(maxsize=50_000)
def places(text: str) -> dict[str, int]:
    """By character, the set of its places as bits of a number."""
    out: dict[str, int] = {}
    bit = 1
    for c in text:
        out[c] = out.get(c, 0) | bit
        bit <<= 1
    return out


#: What ``prepared`` has found for the pairs in hand.
_JARO: dict[tuple[str, str], float] = {}
_EDITS: dict[tuple[str, str], float] = {}


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler over code points; half transpositions count, the prefix bonus always applies."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    found = _JARO.get((a, b))
    return _jaro_winkler(a, b) if found is None else found


def plain_jaro_winkler(a: str, b: str) -> float:
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = dict(places(b))  # by character: where it stands in b and is not taken yet
    window, taken, mine = (1 << reach + 1) - 1, 0, []
    for i, c in enumerate(a):
        if at := free.get(c, 0) & window:
            at &= -at
            free[c] ^= at
            taken |= at
            mine.append(c)
        window = window << 1 | (i < reach)
    if not mine:
        return 0.0
    theirs = [c for c, used in zip(b, f"{taken:b}"[::-1], strict=False) if used == "1"]
    moved = sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2
    m = len(mine)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


_jaro_winkler = lru_cache(maxsize=200_000)(plain_jaro_winkler)


def levenshtein_similarity(a: str, b: str) -> float:
    """1 minus edit distance over the longer length."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    found = _EDITS.get((a, b))
    return _levenshtein_similarity(a, b) if found is None else found


def plain_levenshtein_similarity(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    if len(a) < len(b):
        a, b = b, a
    # Myers: a column of the table at a time, its steps up and down as bits of two numbers
    at, every = places(a), (1 << len(a)) - 1
    up, down = every, 0
    for c in b:
        x = at.get(c, 0) | down
        same = ((x & up) + up ^ up | x) & every
        right = (down | every & ~(up | same)) << 1 | 1
        up, down = ((up & same) << 1 | ~(right | same)) & every, right & same
    return 1 - (len(b) + up.bit_count() - down.bit_count()) / longest


_levenshtein_similarity = lru_cache(maxsize=200_000)(plain_levenshtein_similarity)


@lru_cache(maxsize=100_000)
def trigrams(text: str) -> Counter:
    padded = f"  {text.lower()} "
    return Counter(padded[i : i + 3] for i in range(len(padded) - 2))


def trigram_similarity(a: str, b: str) -> float:
    """Jaccard of the multisets of padded trigrams."""
    x, y = trigrams(a), trigrams(b)
    if len(x) > len(y):
        x, y = y, x
    common = sum(min(n, y[t]) for t, n in x.items() if t in y)
    return common / (x.total() + y.total() - common)


class Metrics(NamedTuple):
    """Which signals take part."""

    jaro_winkler: bool = True
    levenshtein: bool = True
    token_sort: bool = True
    phonetic: bool = True
    trigram: bool = True
    thai_phonetic: bool = True
    romanized: bool = True
    corpus_idf: bool = True


class Rules(NamedTuple):
    """Weights and limits of the composite score."""

    metrics: Metrics = Metrics()
    name_weight: float = 0.85
    date_weight: float = 0.15
    date_tolerance: int = 30
    overlap_cap: float = 0.85
    overlap_floor: float = 0.30


class Score(NamedTuple):
    total: float
    name: float
    date: float
    jaro_winkler: float
    levenshtein: float
    token_sort: float
    trigram: float
    romanized: float
    cross_script: bool
    reasons: list[str]


#: Reasons as results carry them.
BRANCH_REASON = "Branch / numerical identifier mismatch penalty (-50%)"
CAPPED_REASON = "No distinctive token in common; capped for review"

Weight = Callable[[str], float]


def number_mismatch(a: list[str], b: list[str]) -> bool:
    return bool(a and b and set(a) != set(b))


def date_score(days: int | None, tolerance: int) -> float:
    """Decay with the days between two dates; 0 beyond a positive tolerance; 1 if either is missing."""
    if days is None:
        return 1.0
    if 0 < tolerance < abs(days):
        return 0.0
    return round4(math.exp(-0.05 * abs(days)))


#: Jaro-Winkler from which two tokens count as the same.
NEAR = 0.85


@lru_cache(maxsize=200_000)
def letters(token: str) -> int:
    """The set of characters as bits of a number; characters may share a bit."""
    out = 0
    for c in token:
        out |= 1 << (ord(c) & 63)
    return out


@lru_cache(maxsize=50_000)
def _shapes(tokens: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, letters and first characters."""
    return np.array([len(t) for t in tokens]), np.array([letters(t) for t in tokens], np.uint64), np.array([ord(t[0]) for t in tokens])


def _common(a: str, b: str) -> float:
    """At most m / a + m / b."""
    n, mine, size, theirs = len(a), letters(a), len(b), letters(b)
    common = min(n - (mine & ~theirs).bit_count(), size - (theirs & ~mine).bit_count())
    return common / n + common / size


def _may_be_near(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places in ``a`` and ``b`` of tokens that may be near: the others have too few characters in common for that.

    With m common characters Jaro is (m / a + m / b + 1) / 3 at most, and Jaro-Winkler 0.4 of the way from
    there to 1 at most, if the first characters agree; the limits leave room for rounding.
    """
    if len(a) * len(b) <= 24:
        return [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if _common(x, y) >= (1.2499 if x[0] == y[0] else 1.5499)]
    (n, mine, first), (size, theirs, start) = _shapes(tuple(a)), _shapes(tuple(b))
    n, mine, first = n[:, None], mine[:, None], first[:, None]
    common = np.minimum(n - np.bitwise_count(mine & ~theirs), size - np.bitwise_count(theirs & ~mine))
    x, y = np.nonzero(common * (1 / n + 1 / size) >= np.where(first == start, 1.2499, 1.5499))
    return list(zip(x.tolist(), y.tolist(), strict=True))


def distinctive_score(a: list[str], b: list[str], weight: Weight | None) -> tuple[float, bool]:
    """Share of the first name's distinctive weight that the second has, and whether a dictionary pair was used.

    Without weights every token counts one, over the larger number of tokens.
    """
    if not a or not b:
        return 0.0, False
    matched = total = 0.0
    across = False
    there, crossing = set(b), any(map(in_dictionary, b))
    near = {a[i] for i, j in _may_be_near(a, b) if a[i] not in there and jaro_winkler(a[i], b[j]) >= NEAR}
    for token in a:
        w = weight(token) if weight else 1.0
        total += w
        if crossing or in_dictionary(token):  # the first that fits decides
            for other in b:
                if token == other or jaro_winkler(token, other) >= NEAR:
                    matched += w
                    break
                if bilingual(token, other):
                    matched += w * 0.95
                    across = True
                    break
        elif token in there or token in near:
            matched += w
    if weight is None:
        return matched / max(len(a), len(b)), across
    return (round4(matched / total), across) if total else (0.0, False)


def shares_distinctive(a: Name, b: Name, weight: Weight | None, floor: float) -> bool:
    """Whether the names have a token of weight ``floor`` in common, or one of them has none at all."""
    if weight is None or a.cleaned == b.cleaned:
        return True
    heavy = [{t for t in n.tokens if weight(t) >= floor} for n in (a, b)]
    return not heavy[0] or not heavy[1] or bool(heavy[0] & heavy[1])


def composite(a: Name, b: Name, days: int | None, rules: Rules = Rules(), weight: Weight | None = None) -> Score:
    """The score of two names and the days between their dates (None: no date to compare).

    Fields that name several parties get the score of their best pair of parties; numbers and tokens of
    the whole fields are held against it.
    """
    left, right = parties_of(a.raw), parties_of(b.raw)
    if len(left) == len(right) == 1:
        return _single(a, b, days, rules, weight)
    best = None
    for x in left:
        for y in right:
            score = composite(party_name(x), party_name(y), days, rules, weight)
            if best is None or score.total > best[0].total:
                best = score, x, y
    score, x, y = best
    name, total, reasons = score.name, score.total, list(score.reasons)
    if number_mismatch(a.numbers, b.numbers):
        name = round4(name * 0.5)
        total = round4(name if days is None else name * rules.name_weight + score.date * rules.date_weight)
        reasons.append(BRANCH_REASON)
    if _unrelated(a, b, score.cross_script, rules, weight) and total > rules.overlap_cap:
        total = rules.overlap_cap
        reasons.append(CAPPED_REASON)
    reasons.append(f"Best of {len(left)}x{len(right)} parties: {_quoted(x)} matched {_quoted(y)}")
    return score._replace(name=name, total=total, reasons=reasons)


def _leaves(a: Name, b: Name) -> Iterator[tuple[Name, Name]]:
    """The pairs of single parties that ``composite`` compares."""
    left, right = parties_of(a.raw), parties_of(b.raw)
    if len(left) == len(right) == 1:
        yield a, b
    else:
        for x in left:
            for y in right:
                yield from _leaves(party_name(x), party_name(y))


def prepared(pairs: Iterable[tuple[Name, Name]], at_a_time: int = 10_000) -> Iterator[tuple[Name, Name]]:
    """The same pairs; what their composites need of the slow metrics is computed for many of them together."""
    held: list[tuple[Name, Name]] = []
    asked: list[tuple[str, str, bool]] = []

    def computed() -> Iterator[tuple[Name, Name]]:
        _JARO.clear()
        _EDITS.clear()
        batched.fill(_JARO, _EDITS, asked)
        yield from held
        held.clear()
        asked.clear()

    for a, b in pairs:
        held.append((a, b))
        for x, y in _leaves(a, b):
            asked.append((x.cleaned, y.cleaned, True))
            asked.append((x.sorted_tokens, y.sorted_tokens, False))
            if x.phonetic_form or y.phonetic_form:
                asked.append((x.phonetic_form or x.cleaned, y.phonetic_form or y.cleaned, False))
                if thai.contains_thai(x.raw) != thai.contains_thai(y.raw):
                    asked.append((x.romanized, y.romanized, False))
        if len(asked) >= at_a_time:
            yield from computed()
    yield from computed()


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _unrelated(a: Name, b: Name, cross: bool, rules: Rules, weight: Weight | None) -> bool:
    return not cross and rules.metrics.corpus_idf and not shares_distinctive(a, b, weight, rules.overlap_floor)


class NameScore(NamedTuple):
    """What of a score no date changes; the name is not rounded yet, unrelated is known only where a total may pass the cap."""

    name: float
    jaro_winkler: float
    levenshtein: float
    token_sort: float
    trigram: float
    romanized: float
    cross_script: bool
    unrelated: bool
    reasons: list[str]


#: Reasons of one party's name, in their order, and of its date.
NAME_REASONS = (
    "Bilingual Thai-English transliteration dictionary match", "High Jaro-Winkler raw string similarity", "High token-sorted similarity (name order invariant)",
    "Low edit distance similarity", "Significant character trigram overlap", "Exact phonetic consonant key match", "High Thai phonetic form similarity",
    "High romanized phonetic skeleton similarity", "High distinctive non-generic token match", BRANCH_REASON,
)
NO_DATE_REASON = "No comparable transaction date; scored on name similarity alone"
DATE_REASONS = ((0.95, "Exact or 1-day transaction date proximity"), (0.70, "Transaction date within close tolerance window"))
FAR_REASON = "Transaction date exceeds tolerance delta"


def name_score(a: Name, b: Name, rules: Rules = Rules(), weight: Weight | None = None) -> NameScore:
    """The part of a score of two names of one party each that comes from the names."""
    use, reasons, ran = rules.metrics, [], []

    def ask(on: bool, value: Callable[[], float], bar: float, reason: str) -> float:
        """Run one metric if it is on; above its bar it gives a reason."""
        if not on:
            return 0.0
        ran.append(value())
        if ran[-1] > bar:
            reasons.append(reason)
        return ran[-1]

    dictionary, raw, ordered, edits, grams, key, form, skeleton, distinctive, branch = NAME_REASONS
    distinct, across = distinctive_score(a.distinctive_tokens, b.distinctive_tokens, weight if use.corpus_idf else None)
    if across:
        reasons.append(dictionary)
    jw = ask(use.jaro_winkler, lambda: jaro_winkler(a.cleaned, b.cleaned), 0.85, raw)
    tokens = ask(use.token_sort, lambda: jaro_winkler(a.sorted_tokens, b.sorted_tokens), 0.85, ordered)
    lev = ask(use.levenshtein, lambda: levenshtein_similarity(a.cleaned, b.cleaned), 0.80, edits)
    tri = ask(use.trigram, lambda: trigram_similarity(a.cleaned, b.cleaned), 0.75, grams)
    if use.phonetic and a.phonetic_key and a.phonetic_key == b.phonetic_key:
        reasons.append(key)
    spoken = use.thai_phonetic and bool(a.phonetic_form or b.phonetic_form)
    ask(spoken, lambda: jaro_winkler(a.phonetic_form or a.cleaned, b.phonetic_form or b.cleaned), 0.85, form)
    cross = use.romanized and bool(a.romanized and b.romanized) and thai.contains_thai(a.raw) != thai.contains_thai(b.raw)
    both = lambda: min(jaro_winkler(a.romanized, b.romanized), thai.parts_score(a.tokens, b.tokens, jaro_winkler))
    roman = ask(cross, both, 0.85, skeleton)

    name = 0.0
    if ran:
        name = 0.6 * max(ran) + 0.4 * (sum(ran) / len(ran))
        if distinct > name:
            name = 0.4 * name + 0.6 * distinct
        if distinct >= 0.85:
            reasons.append(distinctive)
    if cross and roman > name:
        name = 0.3 * name + 0.7 * roman
    if number_mismatch(a.numbers, b.numbers):
        name *= 0.5
        reasons.append(branch)
    most = max(name, name * rules.name_weight + rules.date_weight)
    unrelated = most > rules.overlap_cap and _unrelated(a, b, cross, rules, weight)
    return NameScore(name, *map(round4, (jw, lev, tokens, tri, roman)), cross, unrelated, reasons)


def _single(a: Name, b: Name, days: int | None, rules: Rules, weight: Weight | None) -> Score:
    found = name_score(a, b, rules, weight)
    name, reasons = found.name, found.reasons
    if days is None:
        date, total = 0.0, name
        reasons.append(NO_DATE_REASON)
    else:
        date = date_score(days, rules.date_tolerance)
        total = name * rules.name_weight + date * rules.date_weight
        if date == 0:
            reasons.append(FAR_REASON)
        else:
            reasons.extend([said for bar, said in DATE_REASONS if date >= bar][:1])
    if total > rules.overlap_cap and found.unrelated:
        total = rules.overlap_cap
        reasons.append(CAPPED_REASON)
    return Score(round4(total), round4(name), round4(date), *found[1:7], reasons)
