"""Scores of many pairs of fields that name several parties, in numpy: what ``similarity.composite`` gives for each of them.

Every pair of parties gets its exact share of distinctive weight and a limit of its total; those whose
limit lies below the total of another pair of parties of the same fields can't be the best and go no further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import thai
from .batched import similarities, trigram_similarities
from .names import Name, in_dictionary, parties_of, party_name
from .similarity import BRANCH_REASON, CAPPED_REASON, DATE_REASONS, FAR_REASON, NAME_REASONS, NEAR, NO_DATE_REASON, Rules, Score, _quoted, composite, date_score, letters, number_mismatch, prepared, round4
from .together import _round4, _sum

#: Fields with longer parties are scored one by one, and so are those with Thai, words of the dictionary or parties within parties.
LONGEST = 4096
#: Pairs of words, of words in a filter and of parties by character that are held at a time.
WORD_PAIRS, FILTERED, PARTY_PAIRS = 4_000_000, 250_000, 50_000
#: Pairs of parties that are worked on together; fields that have many more of them are scored one by one.
TOGETHER = 500_000
#: What metrics come to of their limits, about: the pair that is scored first is picked by it.
LIKELY = (0.8, 0.8, 0.4, 0.2)
#: Room for rounding, of a limit and of a score.
ROOM = 2e-4


def _split(name: Name) -> list[Name] | None:
    """The parties of a field as they are compared, or None where they are compared one by one."""
    texts = parties_of(name.raw)
    if thai.contains_thai(name.raw) or len(texts) > 1 and any(len(parties_of(t)) > 1 for t in texts):
        return None
    found = [party_name(t) for t in texts]
    if any(x.phonetic_form or len(x.cleaned) > LONGEST or any(map(in_dictionary, x.distinctive_tokens)) for x in found):
        return None
    return found


def _ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as asked."""
    ends = np.cumsum(many)
    return np.repeat(start - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)


def _starts(many: np.ndarray) -> np.ndarray:
    return np.cumsum(many) - many


def _chunks(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Consecutive places whose sizes sum to about ``limit``, or one place beyond it."""
    upto, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + limit, "right")))
        yield slice(lo, hi)
        lo = hi


def _flat(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _counts(texts: list[str], sizes: np.ndarray) -> np.ndarray:
    """How often each character is in a text; characters may share a column, which only adds to what two texts have in common."""
    cell = np.repeat(np.arange(len(texts)) * 32, sizes) + (_flat(texts) & 31)
    return np.bincount(cell, minlength=32 * len(texts)).reshape(-1, 32).astype(np.int16)


def _openings(texts: list[str]) -> np.ndarray:
    """The first four characters, 0 after the end."""
    return _flat([t[:4].ljust(4, "\0") for t in texts]).reshape(-1, 4).astype(np.int32)


class _Fields:
    """Fields by number with their parties, and parties by number with what their scores need."""

    def __init__(self, names: list[Name], weights: list[dict] | None) -> None:
        self.names, self.worth = names, {}
        array = lambda values, kind=np.int64: np.array(list(values), kind)
        known: dict[str, int] = {}
        self.parties: list[Name] = []
        self.plain = np.zeros(len(names), bool)
        own: list[list[int]] = []
        for i, x in enumerate(names):
            if weights is not None and any([self.worth.setdefault(t, w) != w for t, w in weights[i].items()]):
                self.plain[i] = True
            found = _split(x)
            if found is None:
                self.plain[i], found = True, []
            for p in found:
                if known.setdefault(p.raw, len(known)) == len(self.parties):
                    self.parties.append(p)
            own.append([known[p.raw] for p in found])
        if weights is not None:  # a word may not weigh something else beside another name
            for i, x in enumerate(names):
                if any(t not in weights[i] and t in self.worth for part in (x, *(self.parties[p] for p in own[i])) for t in part.tokens):
                    self.plain[i] = True
        self.many, self.own = array(map(len, own)), array(p for x in own for p in x)
        self.begin = _starts(self.many)
        texts: dict[str, int] = {}
        number = lambda t: texts.setdefault(t, len(texts))
        self.cleaned, self.ordered = (array(map(number, x)) for x in ([p.cleaned for p in self.parties], [p.sorted_tokens for p in self.parties]))
        self.texts = list(texts)
        self.size = array(len(p.cleaned) for p in self.parties)
        self.counts = _counts([p.cleaned for p in self.parties], self.size)
        self.starts = [_openings(x) for x in ([p.cleaned for p in self.parties], [p.sorted_tokens for p in self.parties])]
        sets: dict[frozenset, int] = {frozenset(): 0}
        self.numbers = array(sets.setdefault(frozenset(p.numbers), len(sets)) for p in self.parties)

        words: dict[str, int] = {}
        self.tokens = array(words.setdefault(t, len(words)) for p in self.parties for t in p.distinctive_tokens)
        self.long = array(len(p.distinctive_tokens) for p in self.parties)
        self.first = _starts(self.long)  # where the tokens of a party begin
        self.words = list(words)
        weight = array((self.worth.get(t, 1.0) if weights is not None else 1.0 for t in words), float)
        self.weight = weight[self.tokens]
        self.total = np.bincount(np.repeat(np.arange(len(self.parties)), self.long), self.weight, len(self.parties))
        self.length = array(len(t) for t in words)
        self.opening = _openings(self.words)
        self.spelt = _counts(self.words, self.length)
        # the distinct words of each field; of each token of its parties, which of them it is; and which of its parties have each of them
        distinct, place, has, having = [], [], [], []
        for parties in own:
            mine = np.concatenate([self.tokens[self.first[p] : self.first[p] + self.long[p]] for p in parties]) if parties else np.zeros(0, np.int64)
            found, back = np.unique(mine, return_inverse=True)
            distinct.append(found)
            place.append(back)
            pair = np.unique(back * max(1, len(parties)) + np.repeat(np.arange(len(parties)), self.long[parties] if parties else 0))
            has.append(pair % max(1, len(parties)))
            having.append(np.bincount(pair // max(1, len(parties)), minlength=len(found)))
        join = lambda x: np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)
        self.differ, self.word = array(map(len, distinct)), join(distinct)
        self.differ_from, self.place, self.place_from = _starts(self.differ), join(place), _starts(array(map(len, place)))
        self.word_letters = array((letters(t) for t in words), np.uint64)[self.word]
        self.word_length = self.length[self.word].astype(np.int16)
        self.word_part = (1 / self.length[self.word]).astype(np.float32)
        self.word_initial = self.opening[self.word, 0]
        self.has, self.having = join(has), join(having)
        self.has_from = _starts(self.having)

    def _may_be_near(self, first: int, mine: np.ndarray, begin: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (from ``first`` on) of words of ``mine`` and those of the words of the other field that may be near, see ``similarity._may_be_near``."""
        theirs = _ranges(begin, many)
        x, y = np.repeat(self.word_letters[mine], many), self.word_letters[theirs]
        common = np.minimum(np.repeat(self.word_length[mine], many) - np.bitwise_count(x & ~y), self.word_length[theirs] - np.bitwise_count(y & ~x))
        share = common * (np.repeat(self.word_part[mine], many) + self.word_part[theirs])
        bar = np.where(np.repeat(self.word_initial[mine], many) == self.word_initial[theirs], np.float32(1.2499), np.float32(1.5499))
        found = np.flatnonzero(share >= bar)
        return np.searchsorted(np.cumsum(many), found, "right") + first, theirs[found]

    def distinct(self, a: np.ndarray, b: np.ndarray, weighted: bool) -> np.ndarray:
        """``similarity.distinctive_score`` of all pairs of parties of the fields ``a`` and ``b``, in order."""
        # whether each word of a field is in, or near a word of, each party of the other
        n, m, parties = self.differ[a], self.differ[b], self.many[b]
        row = np.repeat(np.arange(len(a)), n)
        mine = _ranges(self.differ_from[a], n)
        begin, many = self.differ_from[b][row], m[row]
        pairs = [self._may_be_near(s.start, mine[s], begin[s], many[s]) for s in _chunks(many, FILTERED)]
        at, theirs = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in pairs)]) for k in range(2))
        s, t = self.word[mine[at]], self.word[theirs]
        near = np.flatnonzero(s != t)
        common = np.minimum(self.spelt[s[near]], self.spelt[t[near]]).sum(axis=1, dtype=np.int64)
        x, y = self.opening[s[near]], self.opening[t[near]]
        bonus = 0.1 * np.cumprod((x == y) & (x > 0), axis=1).sum(axis=1)
        near = near[common * (1 / self.length[s[near]] + 1 / self.length[t[near]]) >= 3 * (NEAR - bonus) / (1 - bonus) - 1 - ROOM]
        like, _ = similarities(self.words, s[near], t[near], False)
        hit = np.append(np.flatnonzero(s == t), near[like >= NEAR])
        at, theirs = at[hit], theirs[hit]
        grid = _starts(parties[row])
        met = np.zeros(int(parties[row].sum()), bool)
        many = self.having[theirs]
        met[np.repeat(grid[at], many) + self.has[_ranges(self.has_from[theirs], many)]] = True
        # sums in the order of each party's tokens
        width = np.repeat(parties, self.many[a])  # of each party of a field: how many it meets
        left = self.own[_ranges(self.begin[a], self.many[a])]
        tokens = self.long[left]
        base = np.append(grid, 0)[np.repeat(_starts(n), self.many[a])]  # a field without words has no tokens either
        pos = _ranges(np.concatenate([self.place_from[i] + _starts(self.long[self.own[self.begin[i] : self.begin[i] + self.many[i]]]) for i in a.tolist()]) if len(a) else np.zeros(0, np.int64), tokens)
        cell = np.repeat(base, tokens) + self.place[pos] * np.repeat(width, tokens)
        worth = self.weight[_ranges(self.first[left], tokens)]
        begin = _starts(tokens)
        pair = np.repeat(np.arange(len(left)), width)  # each pair of parties
        inner = _ranges(np.zeros(len(left), np.int64), width)
        each = _ranges(begin[pair], tokens[pair])
        matched = np.bincount(np.repeat(np.arange(len(pair)), tokens[pair]), np.where(met[cell[each] + np.repeat(inner, tokens[pair])], worth[each], 0.0), len(pair))
        right = self.own[_ranges(np.repeat(self.begin[b], self.many[a]), width)]
        left = left[pair]
        if weighted:
            score = _round4(np.divide(matched, self.total[left], out=np.zeros(len(pair)), where=self.total[left] != 0))
        else:
            score = matched / np.maximum(1, np.maximum(self.long[left], self.long[right]))
        return np.where((self.long[left] > 0) & (self.long[right] > 0), score, 0.0)


def _names(metrics: list[np.ndarray], distinct: np.ndarray, mismatch: np.ndarray) -> np.ndarray:
    """``similarity.name_score`` from the values of Jaro-Winkler, token order, edits and trigrams."""
    name = 0.6 * np.maximum.reduce(metrics) + 0.4 * (_sum(metrics) / len(metrics))
    name = np.where(distinct > name, 0.4 * name + 0.6 * distinct, name)
    return np.where(mismatch, name * 0.5, name)


class _Search:
    """The pairs of parties of pairs of fields, and the best of each."""

    def __init__(self, of: _Fields, left: np.ndarray, right: np.ndarray, days: list[int | None], rules: Rules, weighted: bool) -> None:
        self.of, self.rules, self.weighted = of, rules, weighted
        self.many = of.many[left] * of.many[right]
        self.begin = _starts(self.many)
        self.field = np.repeat(np.arange(len(left)), self.many)
        wide = of.many[right][self.field]
        inner = _ranges(np.zeros(len(left), np.int64), self.many)
        self.a, self.b = of.own[of.begin[left][self.field] + inner // np.maximum(1, wide)], of.own[of.begin[right][self.field] + inner % np.maximum(1, wide)]
        self.dates = [None if d is None else date_score(d, rules.date_tolerance) for d in days]
        self.undated = np.array([d is None for d in days], bool)[self.field]
        self.date = np.array([d or 0.0 for d in self.dates], float)[self.field]
        parts = [of.distinct(left[s], right[s], weighted) for s in _chunks(of.differ[left] * of.differ[right], WORD_PAIRS)]
        self.distinct = np.concatenate(parts) if parts else np.zeros(0)
        self.mismatch = (of.numbers[self.a] > 0) & (of.numbers[self.b] > 0) & (of.numbers[self.a] != of.numbers[self.b])
        self.heavy: dict[int, set[str]] = {}

    def limits(self) -> list[np.ndarray]:
        """What each metric comes to at most: characters that both have, in any order, and equal beginnings bound them."""
        of, a, b = self.of, self.a, self.b
        common = np.concatenate([np.zeros(0, np.int64)] + [np.minimum(of.counts[a[i : i + PARTY_PAIRS]], of.counts[b[i : i + PARTY_PAIRS]]).sum(axis=1, dtype=np.int64) for i in range(0, len(a), PARTY_PAIRS)])
        n, m = of.size[a], of.size[b]
        most, least = np.maximum(n, m), np.minimum(n, m)
        jaro = np.where(common > 0, (common / np.maximum(1, n) + common / np.maximum(1, m) + 1) / 3, np.where(most == 0, 1.0, 0.0))
        out = []
        for starts in of.starts:
            x, y = starts[a], starts[b]
            prefix = np.cumprod((x == y) & (x > 0), axis=1).sum(axis=1)
            out.append(jaro + prefix * 0.1 * (1 - jaro))
        return [*out, np.where(most == 0, 1.0, common / np.maximum(1, most)), (least + 1) / (most + 1)]

    def totals(self, at: np.ndarray, metrics: list[np.ndarray]) -> np.ndarray:
        """Totals of names before they are rounded and capped."""
        name = _names([x[at] for x in metrics], self.distinct[at], self.mismatch[at])
        return np.where(self.undated[at], name, name * self.rules.name_weight + self.date[at] * self.rules.date_weight)

    def unrelated(self, a: Name, b: Name) -> bool:
        if not self.weighted or a.cleaned == b.cleaned:
            return False
        x, y = (self.heavy.get(id(n)) for n in (a, b))
        if x is None:
            x = self.heavy[id(a)] = {t for t in a.tokens if self.of.worth.get(t, 1.0) >= self.rules.overlap_floor}
        if y is None:
            y = self.heavy[id(b)] = {t for t in b.tokens if self.of.worth.get(t, 1.0) >= self.rules.overlap_floor}
        return bool(x and y and not x & y)

    def best(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair of fields the place of its best pair of parties (the first of equal ones); by place the metrics, names, totals and whether the cap counts."""
        of, rules = self.of, self.rules
        metrics = self.limits()
        every = np.arange(len(self.a))
        limit = self.totals(every, metrics)
        name, total, capped = np.zeros(len(every)), np.full(len(every), -1.0), np.zeros(len(every), bool)
        texts = of.texts

        def ordered(at: np.ndarray) -> None:
            metrics[1][at] = similarities(texts, of.ordered[self.a[at]], of.ordered[self.b[at]], False)[0]

        def raw(at: np.ndarray) -> None:
            metrics[0][at] = similarities(texts, of.cleaned[self.a[at]], of.cleaned[self.b[at]], False)[0]

        def edits(at: np.ndarray) -> None:
            metrics[2][at] = similarities(texts, of.cleaned[self.a[at]], of.cleaned[self.b[at]], True, False)[1]

        def grams(at: np.ndarray) -> None:
            metrics[3][at] = trigram_similarities(texts, of.cleaned[self.a[at]], of.cleaned[self.b[at]])

        def scored(at: np.ndarray) -> None:
            name[at] = _names([x[at] for x in metrics], self.distinct[at], self.mismatch[at])
            found = self.totals(at, metrics)
            asked = np.maximum(name[at], name[at] * rules.name_weight + rules.date_weight) > rules.overlap_cap
            for i in np.flatnonzero(asked & (found > rules.overlap_cap)).tolist():
                if self.unrelated(of.parties[self.a[at[i]]], of.parties[self.b[at[i]]]):
                    found[i], capped[at[i]] = rules.overlap_cap, True
            total[at] = _round4(found)

        likely = self.totals(every, [x * share for x, share in zip(metrics, LIKELY, strict=True)])
        head = np.flatnonzero(likely == np.maximum.reduceat(likely, self.begin)[self.field])
        head = head[np.unique(self.field[head], return_index=True)[1]]
        for step in (raw, ordered, grams, edits, scored):
            step(head)
        low = total[head]
        left = np.ones(len(every), bool)
        left[head] = False
        left = np.flatnonzero(left)
        left = left[limit[left] + ROOM >= low[self.field[left]]]
        for step in (raw, ordered, grams, edits):
            step(left)
            left = left[self.totals(left, metrics) + ROOM >= low[self.field[left]]]
        scored(left)
        top = np.maximum.reduceat(total, self.begin)
        found = np.flatnonzero(total == top[self.field])
        return found[np.unique(self.field[found], return_index=True)[1]], metrics, name, total, capped


def composites(names: list[Name], left: np.ndarray, right: np.ndarray, days: list[int | None], rules: Rules = Rules(), weights: list[dict] | None = None) -> list[Score]:
    """``similarity.composite`` of the pairs of fields ``left`` and ``right`` (numbers in ``names``); weights: what the corpus gives each field's tokens."""
    use = rules.metrics
    weighted = weights is not None and use.corpus_idf
    of = _Fields(names, weights if weighted else None)
    pairs = of.many[left] * of.many[right]
    plain = of.plain[left] | of.plain[right] | (pairs <= 1) | (pairs > 2 * TOGETHER)
    if not (use.jaro_winkler and use.token_sort and use.levenshtein and use.trigram):
        plain[:] = True
    out: list[Score | None] = [None] * len(left)
    numbers = np.flatnonzero(~plain)
    for some in _chunks(pairs[numbers], TOGETHER):
        rest = numbers[some]
        _, raw, ordered, edits, grams, key, _, _, distinctive, branch = NAME_REASONS
        search = _Search(of, left[rest], right[rest], [days[i] for i in rest.tolist()], rules, weighted)
        best, metrics, name, total, capped = search.best()
        shown = [_round4(x[best]).tolist() for x in metrics]
        exact = [x[best].tolist() for x in metrics]
        for k, (i, at) in enumerate(zip(rest.tolist(), best.tolist(), strict=True)):
            date = search.dates[k]
            a, b, x, y = names[left[i]], names[right[i]], of.parties[search.a[at]], of.parties[search.b[at]]
            reasons = [said for value, bar, said in ((exact[0][k], 0.85, raw), (exact[1][k], 0.85, ordered), (exact[2][k], 0.80, edits), (exact[3][k], 0.75, grams)) if value > bar]
            if use.phonetic and x.phonetic_key and x.phonetic_key == y.phonetic_key:
                reasons.append(key)
            if search.distinct[at] >= 0.85:
                reasons.append(distinctive)
            if search.mismatch[at]:
                reasons.append(branch)
            if date is None:
                reasons.append(NO_DATE_REASON)
            elif date == 0:
                reasons.append(FAR_REASON)
            else:
                reasons.extend([said for bar, said in DATE_REASONS if date >= bar][:1])
            if capped[at]:
                reasons.append(CAPPED_REASON)
            whole, sum_ = round4(name[at].item()), total[at].item()
            day = 0.0 if date is None else round4(date)
            if number_mismatch(a.numbers, b.numbers):
                whole = round4(whole * 0.5)
                sum_ = round4(whole if date is None else whole * rules.name_weight + day * rules.date_weight)
                reasons.append(BRANCH_REASON)
            if sum_ > rules.overlap_cap and search.unrelated(a, b):
                sum_ = rules.overlap_cap
                reasons.append(CAPPED_REASON)
            sizes = of.many[left[i]], of.many[right[i]]
            reasons.append(f"Best of {sizes[0]}x{sizes[1]} parties: {_quoted(x.raw)} matched {_quoted(y.raw)}")
            out[i] = Score(sum_, whole, day, shown[0][k], shown[2][k], shown[1][k], shown[3][k], 0.0, False, reasons)
    rows = np.flatnonzero(plain).tolist()
    known = [{} if weights is None else weights[i] | weights[j] for i, j in zip(left[rows].tolist(), right[rows].tolist(), strict=True)]
    for i, own, (x, y) in zip(rows, known, prepared((names[left[i]], names[right[i]]) for i in rows), strict=True):
        out[i] = composite(x, y, days[i], rules, None if weights is None else lambda t, own=own: own.get(t, 1.0))
    return out
