"""Token counts of a byte-level BPE by rank-synchronous merging of arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks

_LOADED: dict[str, RankCounter] = {}


class RankCounter:
    """Counts tokens with the ranks of a byte-level BPE file.

    All pre-tokens of a batch lie end to end in one array of symbols, with their
    lengths beside it and the rank of each symbol with its right neighbour beside
    it. In each step every pre-token merges its pair of lowest rank wherever it
    stands (from the left, where pairs overlap), the array closes up, and only pairs beside a merge are looked up again;
    pre-tokens without a ranked pair leave. What remains of each is its number of
    tokens.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        pre, model = spec["pre_tokenizer"], spec["model"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model["type"] != "BPE":
            raise ValueError(f"{path} is not a plain byte-level BPE")
        vocab = model["vocab"]
        self.of_byte = np.zeros(256, np.int64)
        for byte, letter in chunks.byte_letters().items():
            self.of_byte[byte] = vocab[letter]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        left, right, made = (np.array([vocab[x] for x in xs], np.int64) for xs in zip(*[(a, b, a + b) for a, b in merges]))
        key = left * self.width + right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        self.none = len(merges)
        self.special = chunks.any_of(t["content"] for t in spec["added_tokens"])
        self.words = chunks.BYTE_LEVEL
        self.cache = chunks.PieceCache(self._solve)

    def _solve(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words: list[bytes] = []
        owner: list[int] = []
        extra = np.zeros(len(pieces), np.int64)
        for i, piece in enumerate(pieces):
            parts = [piece]
            if self.special is not None and self.special.search(piece):
                extra[i] = len(self.special.findall(piece))
                parts = self.special.split(piece)
            for part in parts:
                found = self.words.findall(part)
                words += [w.encode() for w in found]
                owner += [i] * len(found)
        count = extra
        if words:
            count = count + np.bincount(np.array(owner), self.merged(words), len(pieces)).astype(np.int64)
        return count.astype(np.int32), np.ones(len(pieces), np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols and the symbol they make."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], self.none), self.made[at]

    def merged(self, words: list[bytes], block: int = 400_000) -> np.ndarray:
        """Number of symbols left of each pre-token (none is empty); at most about ``block`` bytes are held at once."""
        out = np.zeros(len(words), np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        cut = np.flatnonzero(np.diff(np.cumsum(size) // block, prepend=-1))
        for a, b in zip(cut, [*cut[1:], len(words)]):
            out[a:b] = self._merge(b"".join(words[a:b]), size[a:b])
        return out

    def _merge(self, data: bytes, size: np.ndarray) -> np.ndarray:
        left = size.copy()
        live = np.arange(len(size))  # pre-tokens still merging
        sym = self.of_byte[np.frombuffer(data, np.uint8)]
        last = np.zeros(len(sym), bool)
        last[np.cumsum(size) - 1] = True
        rank, made = np.full(len(sym), self.none, np.int32), np.zeros(len(sym), np.int64)
        look = np.flatnonzero(~last)
        rank[look], made[look] = self._pairs(sym[look], sym[look + 1])
        while len(live):
            n = left[live]
            starts = np.cumsum(n) - n
            best = np.minimum.reduceat(rank, starts)
            going = best < self.none
            at = np.flatnonzero((rank == np.repeat(best, n)) & (rank < self.none))
            run = np.flatnonzero(np.diff(at, prepend=-2) > 1)  # where a row of overlapping pairs such as aaaa begins
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0]
            left[live] -= np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(live))
            sym[at] = made[at]
            last[at] = last[at + 1]
            keep = np.repeat(going, n)
            keep[at + 1] = False
            sym, last, rank, made = sym[keep], last[keep], rank[keep], made[keep]
            at = (np.cumsum(keep) - 1)[at]
            before = at[at > 0] - 1
            look = np.concatenate((at, before[~last[before]]))
            rank[at] = self.none
            look = look[~last[look]]
            rank[look], made[look] = self._pairs(sym[look], sym[look + 1])
            live = live[going]
        return left

    def count(self, texts: list[str]) -> np.ndarray:
        pieces, at, counts = chunks.pieces(texts)
        numbers = self.cache.numbers(pieces)
        out = chunks.sums(self.cache.flat[self.cache.starts[numbers]][at], counts)
        self.cache.trim()
        return out


def _counter(path: str) -> RankCounter:
    if path not in _LOADED:
        _LOADED[path] = RankCounter(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """Per row of ``docs``: key, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    ``path`` names the vocabulary file, which must exist on every worker. Null
    and empty texts have 0 bytes and 0 tokens. Only key and text are read; repeated
    rows are counted one by one; an empty table gives an empty result. Rows stay
    in their partitions. A task holds one batch of about two million characters
    and one bounded cache of pieces; a longer text is a batch of its own.
    """
    kind = docs.select(key).schema[0].dataType

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for frame in frames:
            texts = frame.column(1).to_pylist()
            n = [counter.count(group) for group in chunks.batches(texts)]
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(2), pa.array(np.concatenate(n) if n else [], pa.int64())], ["k", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("b"))
    out = rows.mapInArrow(count, f"k {kind.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
