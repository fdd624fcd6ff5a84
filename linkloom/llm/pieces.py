"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The texts of a batch become one flat array of symbols. In every round each word finds the pair of
neighbours with the smallest rank, merges it at its leftmost places at once, and the array is compacted;
a word without a known pair is finished. The order of merges is the library's: where a merged piece could
itself take part in a merge of smaller rank, only its leftmost place merges in that round.

Words are cut where a space mark follows another character, which no piece crosses (checked on loading).
Distinct words are encoded once per worker and kept in a bounded memo.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import pick, resident, slices, small_batches
from .hashing import IntTable

MARK = "▁"
NONE = np.iinfo(np.int32).max
#: Entries that a worker's memo of words holds before it starts afresh, and bytes of their words, ids and texts.
MEMO_WORDS, MEMO_BYTES = 80_000, 6 << 20
#: Characters of distinct words that are encoded in one call.
BATCH_CHARS = 1 << 19
#: Bytes of text that are cut into words at a time.
SLICE_BYTES = 1 << 20

_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceModel:
    """Tables of a BPE model with byte fallback, read from the bytes of its file."""

    def __init__(self, model: bytes):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        normal = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        pieces = {lib.id_to_piece(i): i for i in normal}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses the start of a word")
        score = {p: lib.get_score(i) for p, i in pieces.items()}
        #: rank by score, ties by id
        rank = {p: r for r, p in enumerate(sorted(pieces, key=lambda p: (-score[p], pieces[p])))}
        symbols = list(pieces)
        number = {p: k for k, p in enumerate(symbols)}
        for p in list(pieces):
            for c in p:  # a character that is only part of pieces is a symbol without an id
                if c not in number:
                    number[c] = len(symbols)
                    symbols.append(c)
        self.unknown = len(symbols)
        #: id by symbol; -1: no piece, so its bytes stand for it
        self.ids = np.full(self.unknown + 1, -1, np.int32)
        for p, i in pieces.items():
            self.ids[number[p]] = i
        self.bytes_from = lib.piece_to_id("<0x00>")
        chars = [c for c in number if len(c) == 1]
        self.chars = np.full(0x110000, self.unknown, np.int32)
        self.chars[[ord(c) for c in chars]] = [number[c] for c in chars]
        self.width = self.unknown + 1
        cuts = [(p, k) for p in pieces for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        self.pairs = IntTable(np.fromiter((number[p[:k]] * self.width + number[p[k:]] for p, k in cuts), np.int64, len(cuts)))
        self.rank = np.array([rank[p] for p, _ in cuts] + [NONE], np.int32)  # the last is for -1, not found
        self.made = np.array([number[p] for p in sorted(rank, key=rank.get)], np.int32)
        inner: set[str] = set()
        for q in pieces:
            for k in range(1, len(q)):
                inner.update(s for s in (q[:k], q[-k:]) if s in rank and rank[q] < rank[s])
        self.careful = np.zeros(len(rank), bool)
        self.careful[[rank[p] for p in inner]] = True
        self.text = [lib.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        for b in range(256):
            self.text[self.bytes_from + b] = bytes([b])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; NONE where no piece is made of them."""
        return self.rank[self.pairs.find(left.astype(np.int64) * self.width + right)]


def merge_rounds(model: PieceModel, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all words, one after the other, and each word's number of ids."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol = model.chars[points]
    word = np.repeat(np.arange(len(words)), [len(w) for w in words])
    start = np.arange(len(points))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbol):
        pair = np.full(len(symbol), NONE, np.int32)
        inside = np.flatnonzero(word[1:] == word[:-1])
        pair[inside] = model.ranks(symbol[inside], symbol[inside + 1])
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        best = np.minimum.reduceat(pair, first)
        sizes = np.diff(np.append(first, len(symbol)))
        ended = best == NONE
        if ended.any():
            over = np.repeat(ended, sizes)
            done.append((start[over], symbol[over]))
            keep = ~over
            symbol, start, word, pair = symbol[keep], start[keep], word[keep], pair[keep]
            best, sizes = best[~ended], sizes[~ended]
            if not len(symbol):
                break
        smallest = np.repeat(best, sizes)
        place = np.flatnonzero(pair == smallest)
        merged = pair[place]
        same = np.zeros(len(place), bool)
        same[1:] = word[place[1:]] == word[place[:-1]]
        # of places that overlap, every second from the run's start; of careful pieces, a word's first
        touching = np.zeros(len(place), bool)
        touching[1:] = same[1:] & (place[1:] == place[:-1] + 1)
        if touching.any():
            run = np.maximum.accumulate(np.where(touching, 0, np.arange(len(place))))
            use = (np.arange(len(place)) - run) % 2 == 0
        else:
            use = np.ones(len(place), bool)
        use &= ~(model.careful[merged] & same)
        place, merged = place[use], merged[use]
        symbol[place] = model.made[merged]
        keep = np.ones(len(symbol), bool)
        keep[place + 1] = False
        symbol, start, word = symbol[keep], start[keep], word[keep]
    start = np.concatenate([s for s, _ in done]) if done else np.zeros(0, np.int64)
    symbol = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int32)
    order = np.argsort(start, kind="stable")
    start, symbol = start[order], symbol[order]
    ids = model.ids[symbol]
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])[start] if len(start) else start
    odd = np.flatnonzero(ids < 0)
    if len(odd):  # bytes in place of characters without a piece; such symbols are single characters
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in points[start[odd]]]
        counts = np.ones(len(ids), np.int64)
        counts[odd] = [len(r) for r in raw]
        flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32) + model.bytes_from
        owner = np.repeat(owner, counts)
        out = np.repeat(ids, counts)
        out[out < 0] = flat
        ids = out
    return ids, np.bincount(owner, minlength=len(words)) if len(words) else np.zeros(0, np.int64)


def words_of(text: str) -> list[str]:
    """A text, with the mark before it and in place of spaces, cut into words."""
    return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []


def encode(model: PieceModel, texts: Iterable[str]) -> list[list[int]]:
    """Piece ids of each text, as the library's ``encode`` gives them."""
    words = [words_of(t) for t in texts]
    ids, counts = merge_rounds(model, [w for ws in words for w in ws])
    ends = np.cumsum(counts)
    out, at = [], 0
    for ws in words:
        a, b = (ends[at - 1] if at else 0), (ends[at + len(ws) - 1] if at + len(ws) else 0)
        out.append(ids[a:b].tolist())
        at += len(ws)
    return out


def decode(model: PieceModel, ids: Iterable[int]) -> str:
    """Text of piece ids: their bytes with marks as spaces, without the space put before a text."""
    return strip_first(b"".join(model.text[i] for i in ids)).decode("utf-8", "replace")


def strip_first(raw: bytes) -> bytes:
    return raw[1:] if raw[:1] == b" " else raw


class Memo:
    """Words seen by this worker: number of ids, ids in decimal with commas, decoded bytes."""

    def __init__(self, model: PieceModel, limit: int = MEMO_WORDS):
        self.model, self.limit, self.known, self.bytes = model, limit, {}, 0

    def learn(self, words: Iterable[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.limit or self.bytes > MEMO_BYTES:
            self.known, self.bytes = {}, 0
            new = list(dict.fromkeys(words))
        for a, b in slices([len(w) for w in new], BATCH_CHARS):
            ids, counts = merge_rounds(self.model, new[a:b])
            digits = [str(i) for i in ids.tolist()]
            ids, at = ids.tolist(), 0
            for w, n in zip(new[a:b], counts.tolist(), strict=True):
                made = (n, ",".join(digits[at : at + n]).encode(), b"".join([self.model.text[i] for i in ids[at : at + n]]))
                self.known[w] = made
                self.bytes += len(w) + len(made[1]) + len(made[2])
                at += n

    def digest(self, words: list[str]) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the decoded text of a document's words."""
        known = [self.known[w] for w in words]
        ids = hashlib.sha256(b",".join([k[1] for k in known])).hexdigest()
        text = hashlib.sha256(strip_first(b"".join([k[2] for k in known]))).hexdigest()
        return sum([k[0] for k in known]), ids, text


def _memo(model: bytes) -> Memo:
    return resident(("pieces", hashlib.sha256(model).digest()), lambda: Memo(PieceModel(model)))


def _digests(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(model.value)
        for batch in batches:
            rows = []
            column = batch.column(1)
            sizes = [0 if x is None else x for x in pc.binary_length(column).to_pylist()]
            for a, b in slices(sizes, SLICE_BYTES):
                words = [words_of(t or "") for t in column.slice(a, b - a).to_pylist()]
                distinct = set().union(*words)
                if len(distinct) > memo.limit:  # one very long text: its words go through in parts
                    rows += [_long(memo, ws) for ws in words]
                    continue
                memo.learn(distinct)
                rows += [memo.digest(ws) for ws in words]
            n, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _long(memo: Memo, words: list[str]) -> tuple[int, str, str]:
    total, ids, text = 0, hashlib.sha256(), hashlib.sha256()
    for a in range(0, len(words), memo.limit // 2):
        part = words[a : a + memo.limit // 2]
        memo.learn(set(part))
        known = [memo.known[w] for w in part]
        raw = b"".join([k[2] for k in known])
        ids.update((b"," if a else b"") + b",".join([k[1] for k in known]))
        text.update(raw if a else strip_first(raw))
        total += sum([k[0] for k in known])
    return total, ids.hexdigest(), text.hexdigest()


def load_model(spark: SparkSession, path: str):
    """The model file's bytes, half a megabyte, as a broadcast."""
    small_batches(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def token_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row of ``docs``, in one pass without a shuffle.

    A null text counts as empty: no ids. Repeated rows give repeated results; other columns are ignored.
    """
    model = load_model(docs.sparkSession, model_path)
    docs = pick(docs, doc_id=id_col, text=text_col)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(_digests(model), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoded(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _memo(model.value).model
        for batch in batches:
            column = batch.column(1)
            sizes = [0 if x is None else x for x in pc.binary_length(column).to_pylist()]
            for a, b in slices(sizes, SLICE_BYTES):
                ids = encode(tables, [t or "" for t in column.slice(a, b - a).to_pylist()])
                text = [decode(tables, i) for i in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32())), pa.array(text, pa.string())], ["doc_id", "ids", "decoded"])

    return run


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of piece ids), decoded (text of those ids) per row of ``docs``."""
    model = load_model(docs.sparkSession, model_path)
    docs = pick(docs, doc_id=id_col, text=text_col)
    return docs.mapInArrow(_encoded(model), f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, decoded string")
