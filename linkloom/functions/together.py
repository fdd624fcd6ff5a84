"""Scores of many pairs of names of one party at a time, in numpy: what ``similarity.name_score`` gives for each of them."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from . import thai
from .batched import LONGEST, similarities, trigram_similarities
from .names import Name, bilingual, in_dictionary
from .similarity import NAME_REASONS, NEAR, Rules, letters, name_score, prepared

#: Names of more tokens are scored one by one, and so are pairs across scripts and pairs of the dictionary.
TOKENS = 6
_BIT = {r: 1 << i for i, r in enumerate(NAME_REASONS)}


class NameScores(NamedTuple):
    """A ``similarity.NameScore`` by columns; said holds the reasons as bits."""

    name: np.ndarray
    jaro_winkler: np.ndarray
    levenshtein: np.ndarray
    token_sort: np.ndarray
    trigram: np.ndarray
    romanized: np.ndarray
    cross_script: np.ndarray
    unrelated: np.ndarray
    said: np.ndarray


def _round4(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 10_000 + 0.5) / 10_000


def _sum(values: list[np.ndarray]) -> np.ndarray:
    """What ``sum`` gives for floats: the parts lost by rounding are added at the end."""
    total, lost = values[0], np.zeros(len(values[0]))
    for x in values[1:]:
        more = total + x
        lost = lost + np.where(np.abs(total) >= np.abs(x), (total - more) + x, (x - more) + total)
        total = more
    return total + lost


class _Names:
    """Names by number: their texts and tokens as numbers, -1 behind the last token, and what else a score needs."""

    def __init__(self, names: list[Name], weights: list[dict] | None, floor: float) -> None:
        texts: dict[str, int] = {}
        words: dict[str, int] = {}
        number = lambda t: texts.setdefault(t, len(texts))
        array = lambda values, kind=np.int64: np.array(list(values), kind)
        self.cleaned = array(number(x.cleaned) for x in names)
        self.ordered = array(number(x.sorted_tokens) for x in names)
        self.form = array(number(x.phonetic_form or x.cleaned) for x in names)
        self.spoken = array((bool(x.phonetic_form) for x in names), bool)
        self.thai = array((thai.contains_thai(x.raw) for x in names), bool)
        self.romanized = array((bool(x.romanized) for x in names), bool)
        keys: dict[str, int] = {"": 0}
        self.key = array(keys.setdefault(x.phonetic_key, len(keys)) for x in names)
        sets: dict[frozenset, int] = {frozenset(): 0}
        self.numbers = array(sets.setdefault(frozenset(x.numbers), len(sets)) for x in names)
        self.odd = array((max(len(x.tokens), len(x.distinctive_tokens)) > TOKENS or max(len(x.cleaned), len(x.phonetic_form)) > LONGEST for x in names), bool)
        self.distinctive, self.heavy = (np.full((len(names), TOKENS), -1) for _ in range(2))
        self.weight = np.zeros((len(names), TOKENS))
        worth: dict[str, float] = {}
        for i, x in enumerate(names):
            own = None if weights is None else weights[i]
            if own is not None and (any(worth.setdefault(t, w) != w for t, w in own.items()) or any(t not in own for t in x.tokens)):
                self.odd[i] = True  # what its tokens weigh depends on the other name
            if not self.odd[i]:
                for j, t in enumerate(x.distinctive_tokens):
                    self.distinctive[i, j] = words.setdefault(t, len(words))
                    self.weight[i, j] = 1.0 if own is None else own[t]
                if own is not None:
                    for j, t in enumerate(x.tokens):
                        if own[t] >= floor:
                            self.heavy[i, j] = words.setdefault(t, len(words))
        self.word = array(number(t) for t in words)
        self.words, self.texts = list(words), list(texts)
        self.size, self.first = array(len(t) for t in words), array(ord(t[0]) for t in words)
        self.letters = array((letters(t) for t in words), np.uint64)
        self.listed = array((in_dictionary(t) for t in words), bool)

    def shared(self, tokens: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each place of the tokens of ``a``, whether the name ``b`` has that token."""
        x, y = tokens[a], tokens[b]
        return np.stack([(x[:, i, None] == y).any(axis=1) & (x[:, i] >= 0) for i in range(TOKENS)], axis=1)

    def distinct(self, a: np.ndarray, b: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
        """``similarity.distinctive_score``, and whether a pair of tokens is one of the dictionary, so that it doesn't hold."""
        x, y = self.distinctive[a], self.distinctive[b]
        hit, across = self.shared(self.distinctive, a, b), np.zeros(len(a), bool)
        for i in range(TOKENS):
            for j in range(TOKENS):
                s, t = x[:, i], y[:, j]
                rows = np.flatnonzero((s >= 0) & (t >= 0) & (s != t))
                s, t = s[rows], t[rows]
                asked = np.flatnonzero(self.listed[s] | self.listed[t])
                across[rows[asked]] |= np.array([bilingual(self.words[p], self.words[q]) for p, q in zip(s[asked].tolist(), t[asked].tolist(), strict=True)], bool)
                # see ``similarity._may_be_near``
                n, m, mine, theirs = self.size[s], self.size[t], self.letters[s], self.letters[t]
                common = np.minimum(n - np.bitwise_count(mine & ~theirs), m - np.bitwise_count(theirs & ~mine))
                near = np.flatnonzero(~hit[rows, i] & (common * (1 / n + 1 / m) >= np.where(self.first[s] == self.first[t], 1.2499, 1.5499)))
                if len(near):
                    like, _ = similarities(self.texts, self.word[s[near]], self.word[t[near]], False)
                    hit[rows[near[like >= NEAR]], i] = True
        matched = total = np.zeros(len(a))
        weight = self.weight[a]
        for i in range(TOKENS):
            matched = matched + np.where(hit[:, i], weight[:, i], 0.0)
            total = total + weight[:, i]
        many, others = (x >= 0).sum(axis=1), (y >= 0).sum(axis=1)
        if weighted:
            score = _round4(np.divide(matched, total, out=np.zeros(len(a)), where=total != 0))
        else:
            score = matched / np.maximum(1, np.maximum(many, others))
        return np.where((many > 0) & (others > 0), score, 0.0), across


def name_scores(names: list[Name], left: np.ndarray, right: np.ndarray, rules: Rules = Rules(), weights: list[dict] | None = None) -> NameScores:
    """Scores of the pairs of names ``left`` and ``right`` (numbers in ``names``); weights: what the corpus gives each name's tokens."""
    use = rules.metrics
    weighted = weights is not None and use.corpus_idf
    of = _Names(names, weights if weighted else None, rules.overlap_floor)
    cross = use.romanized & of.romanized[left] & of.romanized[right] & (of.thai[left] != of.thai[right])
    plain = cross | of.odd[left] | of.odd[right]
    rest = np.flatnonzero(~plain)
    distinct, across = of.distinct(left[rest], right[rest], weighted)
    plain[rest[across]] = True
    rest, distinct = rest[~across], distinct[~across]
    a, b = left[rest], right[rest]

    none, off = np.zeros(len(rest)), np.zeros(len(rest), bool)
    said = np.zeros(len(rest), np.int64)
    ran: list[np.ndarray] = []

    def ask(value: np.ndarray, bar: float, reason: str) -> np.ndarray:
        nonlocal said
        ran.append(value)
        said |= np.where(value > bar, _BIT[reason], 0)
        return value

    _, raw, ordered, edits, grams, key, form, _, distinctive, branch = NAME_REASONS
    jw = lev = tokens = tri = none
    alike, near = similarities(of.texts, of.cleaned[a], of.cleaned[b], use.levenshtein) if use.jaro_winkler or use.levenshtein else (none, none)
    if use.jaro_winkler:
        jw = ask(alike, 0.85, raw)
    if use.token_sort:
        tokens = ask(similarities(of.texts, of.ordered[a], of.ordered[b], False)[0], 0.85, ordered)
    if use.levenshtein:
        lev = ask(near, 0.80, edits)
    if use.trigram:
        tri = ask(trigram_similarities(of.texts, of.cleaned[a], of.cleaned[b]), 0.75, grams)
    if use.phonetic:
        said |= np.where((of.key[a] > 0) & (of.key[a] == of.key[b]), _BIT[key], 0)
    name = none
    if ran:
        most, mean = np.maximum.reduce(ran), _sum(ran) / len(ran)
    spoken = np.flatnonzero(of.spoken[a] | of.spoken[b]) if use.thai_phonetic else np.zeros(0, np.int64)
    if len(spoken):
        like, _ = similarities(of.texts, of.form[a[spoken]], of.form[b[spoken]], False)
        said[spoken] |= np.where(like > 0.85, _BIT[form], 0)
        every = [x[spoken] for x in ran] + [like]
        if not ran:
            most, mean = np.zeros(len(rest)), np.zeros(len(rest))
        most[spoken], mean[spoken] = np.maximum.reduce(every), _sum(every) / len(every)
    some = np.ones(len(rest), bool) if ran else off.copy()
    some[spoken] = True
    if some.any():
        name = np.where(some, 0.6 * most + 0.4 * mean, 0.0)
        name = np.where(some & (distinct > name), 0.4 * name + 0.6 * distinct, name)
        said |= np.where(some & (distinct >= 0.85), _BIT[distinctive], 0)
    numbers = (of.numbers[a] > 0) & (of.numbers[b] > 0) & (of.numbers[a] != of.numbers[b])
    name = np.where(numbers, name * 0.5, name)
    said |= np.where(numbers, _BIT[branch], 0)
    unrelated = off
    if weighted:
        heavy = (of.heavy >= 0).any(axis=1)
        related = (of.cleaned[a] == of.cleaned[b]) | ~heavy[a] | ~heavy[b] | of.shared(of.heavy, a, b).any(axis=1)
        unrelated = (np.maximum(name, name * rules.name_weight + rules.date_weight) > rules.overlap_cap) & ~related

    out = NameScores(*(np.zeros(len(left)) for _ in range(6)), *(np.zeros(len(left), bool) for _ in range(2)), np.zeros(len(left), np.int64))
    for column, value in zip(out, (name, *map(_round4, (jw, lev, tokens, tri, none)), off, unrelated, said), strict=True):
        column[rest] = value
    rows = np.flatnonzero(plain).tolist()
    known = [{} if weights is None else weights[i] | weights[j] for i, j in zip(left[rows].tolist(), right[rows].tolist(), strict=True)]
    for i, own, (x, y) in zip(rows, known, prepared((names[left[i]], names[right[i]]) for i in rows), strict=True):
        found = name_score(x, y, rules, None if weights is None else lambda t, own=own: own.get(t, 1.0))
        for column, value in zip(out, (*found[:8], sum(_BIT[r] for r in found.reasons)), strict=True):
            column[i] = value
    return out
