"""Jaro-Winkler and edit distances of many pairs of texts at a time: sets of places as words of 64 bits, in numpy."""

from __future__ import annotations

import numpy as np

#: Pairs that are worked on together; texts beyond LONGEST are left to the plain functions.
TOGETHER, LONGEST = 4096, 512
#: Pairs for each word of b below which the plain functions are faster.
FEW = 30
#: Trigrams that are looked up at a time.
AT_A_TIME = 1_000_000
_ONE = np.uint64(1)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each text in a row, 0 after its end, and the lengths; code points are shifted by one."""
    sizes = np.array([len(t) for t in texts])
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32) + 1
    out = np.zeros((len(texts), int(sizes.max())), np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


class Pairs:
    """Pairs of texts that are not empty, by their numbers in ``texts``, as rows of codes, with where each character stands in b.

    Rows are worked on in the order of a's length, so that those that have ended are the first.
    """

    def __init__(self, texts: list[str], left: np.ndarray, right: np.ndarray) -> None:
        (mine, row), (theirs, which) = (np.unique(x, return_inverse=True) for x in (left, right))
        (a, n), (b, sizes) = (_codes([texts[i] for i in x.tolist()]) for x in (mine, theirs))
        self.order = np.argsort(n[row], kind="stable")
        row, which = row[self.order], which[self.order]
        self.a, self.n, self.b, self.m = a[row], n[row], b[which], sizes[which]
        self.words = -(-b.shape[1] // 64)
        known = np.zeros(max(int(a.max()), int(b.max())) + 1, bool)  # characters of any b; 0 comes first
        known[b.ravel()] = True
        known[0] = True
        number = np.where(known, np.cumsum(known) - 1, known.sum())  # or else not in any b
        chars = int(known.sum()) + 1
        own = (number[b] + np.arange(len(theirs))[:, None] * chars).T.copy()
        self.places = [np.zeros(len(theirs) * chars, np.uint64) for _ in range(self.words)]
        for i, at in enumerate(own):
            self.places[i // 64][at] |= _ONE << np.uint64(i % 64)
        for x in self.places:
            x[::chars] = 0
        self.code = (number[a[row]] + (which * chars)[:, None]).T.copy()
        self.going = np.searchsorted(self.n, np.arange(a.shape[1]), "right").tolist()  # the first row that has not ended

    def given(self, values: np.ndarray) -> np.ndarray:
        """Values of the rows in the order in which the pairs were given."""
        out = np.empty_like(values)
        out[self.order] = values
        return out

    def edit_distances(self) -> np.ndarray:
        return self.given(self._edit_distances())

    def _edit_distances(self) -> np.ndarray:
        """Myers' columns, here along a: a step goes through the words of b with what is carried between them."""
        rows = len(self.n)
        every_up, every_down = np.full((self.words, rows), ~np.uint64(0)), np.zeros((self.words, rows), np.uint64)
        top = np.uint64(63)
        for code, going in zip(self.code, self.going, strict=True):
            code = code[going:]
            more, less = np.ones(len(code), np.uint64), np.zeros(len(code), np.uint64)  # the row before the first goes up by one
            add = np.zeros(len(code), np.uint64)
            for w in range(self.words):
                up, down = every_up[w, going:], every_down[w, going:]
                x = self.places[w].take(code)
                x |= down
                both = x & up
                total = both + up
                if w + 1 < self.words or w:
                    part = total
                    total = part + add
                    add = ((part < both) | (total < part)).astype(np.uint64)
                same = (total ^ up) | x
                right, left = down | ~(up | same), up & same
                next_more, next_less = right >> top, left >> top
                right <<= _ONE
                right |= more
                left <<= _ONE
                left |= less
                more, less = next_more, next_less
                np.bitwise_or(left, ~(right | same), out=up)
                np.bitwise_and(right, same, out=down)
        out = self.n.copy()
        for w in range(self.words):
            bits = np.clip(self.m - 64 * w, 0, 64)
            mask = np.where(bits == 64, ~np.uint64(0), (_ONE << np.minimum(bits, 63).astype(np.uint64)) - _ONE)
            out += np.bitwise_count(every_up[w] & mask).astype(np.int64) - np.bitwise_count(every_down[w] & mask)
        return out

    def levenshtein(self) -> np.ndarray:
        return self.given(1 - self._edit_distances() / np.maximum(self.n, self.m))

    def jaro_winkler(self) -> np.ndarray:
        rows = len(self.n)
        reach = np.maximum(0, np.maximum(self.n, self.m) // 2 - 1)
        free = np.full((self.words, rows), ~np.uint64(0))
        hit = np.zeros((len(self.code), rows), bool)
        window = np.empty((self.words, rows), np.uint64)  # places that are near enough
        for w in range(self.words):
            bits = np.clip(reach + 1 - 64 * w, 0, 64)
            window[w] = np.where(bits == 64, ~np.uint64(0), (_ONE << np.minimum(bits, 63).astype(np.uint64)) - _ONE)
        top, farthest = np.uint64(63), int(reach.max())
        for i, (code, going) in enumerate(zip(self.code, self.going, strict=True)):
            code = code[going:]
            found = None
            carried = (reach[going:] > i).astype(np.uint64) if i < farthest else np.uint64(0)
            for w in range(self.words):
                near = self.places[w].take(code)
                mine, seen = free[w, going:], window[w, going:]
                near &= mine
                near &= seen
                near &= ~near + _ONE  # the first of them
                if found is not None:
                    near[found] = 0
                mine ^= near
                found = near != 0 if found is None else found | (near != 0)
                if w + 1 < self.words:
                    next_carried = seen >> top
                seen <<= _ONE
                seen |= carried
                if w + 1 < self.words:
                    carried = next_carried
            hit[i, going:] = found
        taken = np.unpackbits(np.ascontiguousarray((~free).T).view(np.uint8), axis=1, bitorder="little").view(bool)[:, : self.b.shape[1]]
        hit = np.ascontiguousarray(hit.T)
        m = hit.sum(axis=1)
        moved = np.bincount(np.repeat(np.arange(rows), m), self.a[hit] != self.b[taken], minlength=rows) / 2
        common = np.maximum(m, 1)
        jaro = np.where(m > 0, (m / self.n + m / self.m + (m - moved) / common) / 3, 0.0)
        width = min(4, self.a.shape[1], self.b.shape[1])
        same = (self.a[:, :width] == self.b[:, :width]) & (self.a[:, :width] > 0)
        prefix = np.cumprod(same, axis=1).sum(axis=1)
        return self.given(np.where(m > 0, jaro + prefix * 0.1 * (1 - jaro), 0.0))


def fill(jaro: dict, edits: dict, pairs: list[tuple[str, str, bool]]) -> None:
    """Put the similarities of pairs (a, b, whether edits are asked too) into memos by (a, b); trivial pairs are left out."""
    asked: dict[tuple[str, str], bool] = {}
    for a, b, both in pairs:
        if a != b and a and b and len(a) <= LONGEST and len(b) <= LONGEST and ((a, b) not in jaro or both and (a, b) not in edits):
            asked[a, b] = asked.get((a, b), False) or both
    texts = {t: i for i, t in enumerate(dict.fromkeys(t for pair in asked for t in pair))}
    for both in (True, False):
        some = [pair for pair, edited in asked.items() if edited == both]
        left, right = (np.array([texts[pair[side]] for pair in some], np.int64) for side in (0, 1))
        like, near = similarities(list(texts), left, right, both)
        jaro.update(zip(some, like.tolist(), strict=True))
        if both:
            edits.update(zip(some, near.tolist(), strict=True))


def similarities(texts: list[str], left: np.ndarray, right: np.ndarray, edited: bool, alike: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Jaro-Winkler if ``alike`` and, if ``edited``, edit similarity of pairs of distinct texts, which are given by number; a pair is worked on once."""
    from . import similarity  # which imports this module

    pair, back = np.unique(left * len(texts) + right, return_inverse=True)
    a, b = pair // max(1, len(texts)), pair % max(1, len(texts))
    size, used = np.zeros(len(texts), np.int64), np.unique(np.append(a, b))
    size[used] = [len(texts[i]) for i in used.tolist()]
    jaro = (a == b).astype(float)
    edits = jaro.copy()
    todo = np.flatnonzero((a != b) & (size[a] > 0) & (size[b] > 0))
    words = -(-size[b[todo]] // 64)
    order = np.lexsort((size[a[todo]], words))
    todo, words = todo[order], words[order]
    lo = 0
    while lo < len(todo):  # texts of one number of words, as many as take the room of TOGETHER texts of 8
        hi = min(lo + max(TOGETHER // 16, min(TOGETHER, 8 * TOGETHER // int(words[lo]))), int(np.searchsorted(words, words[lo], "right")))
        some, few = todo[lo:hi], hi - lo < FEW * int(words[lo])
        lo = hi
        if few:
            for i, x, y in zip(some.tolist(), a[some].tolist(), b[some].tolist(), strict=True):
                if alike:
                    jaro[i] = similarity.plain_jaro_winkler(texts[x], texts[y])
                if edited:
                    edits[i] = similarity.plain_levenshtein_similarity(texts[x], texts[y])
            continue
        work = Pairs(texts, a[some], b[some])
        if alike:
            jaro[some] = work.jaro_winkler()
        if edited:
            edits[some] = work.levenshtein()
    return jaro[back], edits[back]


def trigram_similarities(texts: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jaccard of the multisets of padded trigrams of pairs of texts, which are given by number."""
    used, place = np.unique(np.append(left, right), return_inverse=True)
    if not len(used):
        return np.zeros(0)
    left, right = place[: len(left)], place[len(left) :]
    padded = [f"  {texts[i].lower()} " for i in used.tolist()]
    size = np.array([len(t) for t in padded], np.int64)
    flat = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(used)), size)
    inside = np.flatnonzero(text[:-2] == text[2:])
    text, size = text[inside], size - 2
    _, gram = np.unique(flat[inside] << 42 | flat[inside + 1] << 21 | flat[inside + 2], return_inverse=True)
    order = np.lexsort((gram, text))
    text, gram = text[order], gram[order]
    fresh = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])))
    nth = np.arange(len(text)) - np.repeat(fresh, np.diff(np.append(fresh, len(text))))  # a trigram that recurs counts as others
    most = int(nth.max()) + 1
    item = gram * most + nth
    n = int(item.max()) + 1
    order = np.lexsort((item, text))
    every = text[order] * n + item[order]
    begin = np.cumsum(size) - size
    out = np.empty(len(left))
    upto = np.cumsum(size[left])
    lo = 0
    while lo < len(left):
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + AT_A_TIME, "right")))
        a, b = left[lo:hi], right[lo:hi]
        many = size[a]
        starts = np.cumsum(many) - many
        asked = every[np.repeat(begin[a] - starts, many) + np.arange(many.sum())] - np.repeat((a - b) * n, many)
        found = np.minimum(np.searchsorted(every, asked), len(every) - 1)
        common = np.add.reduceat(every[found] == asked, starts, dtype=np.int64)
        out[lo:hi] = common / (many + size[b] - common)
        lo = hi
    return out
