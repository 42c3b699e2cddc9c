"""Token ids as ORC files: written in document order, read back stripe by stripe."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chunks

_LOADED: dict[str, Encoder] = {}


@dataclass(frozen=True)
class OrcLayout:
    """Writer settings: integers are run-length encoded by the format; ids get a Bloom filter and row indexes."""

    stripe_bytes: int = 16 * 1024 * 1024
    index_stride: int = 1000
    bloom_rate: float = 0.01
    codec: str = "zstd"
    level: int = 1

    def options(self, key: str) -> dict[str, str]:
        return {
            "orc.stripe.size": str(self.stripe_bytes), "orc.row.index.stride": str(self.index_stride), "orc.create.index": "true",
            "orc.bloom.filter.columns": key, "orc.bloom.filter.fpp": str(self.bloom_rate), "compression": self.codec,
            "orc.compression.zstd.level": str(self.level),
        }


class Encoder:
    """Token ids from the tokenizers library, with the ids of a repeated piece looked up instead of encoded again.

    A plain byte-level tokenizer is its split into pre-tokens and its model. A batch's
    distinct pieces are split here, and the pre-tokens that are new in a batch go to the
    library thousands in a call, written in the vocabulary's letters and cut at
    spaces, which those letters lack; as a letter is a byte, the lengths of the tokens
    tell which belong to which pre-token. Pieces that hold one of its added tokens,
    and all pieces of any other tokenizer, go through the library's encode.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tool = Tokenizer.from_file(path)
        spec = json.loads(self.tool.to_str())
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        letters = chunks.byte_letters()
        self.plain = (
            pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not spec["normalizer"]
            and model["type"] == "BPE" and not any(model.get(x) for x in ("ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix"))
            and all(x in model["vocab"] for x in letters.values())
        )
        self.special = [t["content"] for t in spec["added_tokens"]]
        if self.plain:
            self.merger = Tokenizer(self.tool.model)
            self.merger.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            self.letter = np.array([ord(letters[b]) for b in range(255)] + [ord(" ")], "<u2")  # no UTF-8 text holds byte 255
            self.width = np.zeros(max(model["vocab"].values()) + 1, np.int64)
            self.width[list(model["vocab"].values())] = list(map(len, model["vocab"]))
        self.cache = chunks.PieceCache(self._solve)

    def _whole(self, strings: pa.Array) -> np.ndarray:
        """Which strings the library must encode as they are."""
        out = np.full(len(strings), not self.plain)
        for special in self.special:
            out |= pc.match_substring(strings, special).to_numpy(zero_copy_only=False)
        return out

    def _words(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct pre-tokens, for each pre-token of each piece its place among them, and how many each piece has."""
        whole = self._whole(pieces)
        # a word is one pre-token, a word and its punctuation are two: only the other pieces need the whole pattern
        one = pc.match_substring_regex(pieces, r"\A ?\pL+\z").to_numpy(zero_copy_only=False) & ~whole
        two = pc.match_substring_regex(pieces, r"\A ?\pL+[,.;:!?]\z").to_numpy(zero_copy_only=False) & ~whole
        rest = np.flatnonzero(~one & ~two)
        found = [[p] if as_is and p else chunks.BYTE_LEVEL.findall(p) for p, as_is in zip(pieces.take(pa.array(rest)).to_pylist(), whole[rest].tolist())]
        pairs = pieces.filter(pa.array(two))
        words = pa.concat_arrays([
            pieces.filter(pa.array(one)), pc.utf8_slice_codeunits(pairs, 0, -1), pc.utf8_slice_codeunits(pairs, -1),
            pa.array(list(chain.from_iterable(found)), pa.string()),
        ])
        one, two = np.flatnonzero(one), np.flatnonzero(two)
        owner = np.concatenate((one, two, two, np.repeat(rest, np.array(list(map(len, found)), np.int64))))
        coded = words.dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy()[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(pieces))

    def _solve(self, words: list[str], most: int = 5_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, at most ``most`` in a call of the library; strings it must encode as they are go one by one."""
        whole = self._whole(pa.array(words, pa.string()))
        rest = [w.encode() for w, one in zip(words, whole.tolist()) if not one]
        ids, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for a in range(0, len(rest), most):
            some = rest[a : a + most]
            text = self.letter[np.frombuffer(b"\xff".join(some), np.uint8)].tobytes().decode("utf-16-le")
            ids.append(np.array(self.merger.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32))
            ends = np.searchsorted(np.cumsum(self.width[ids[-1]]), np.cumsum(list(map(len, some)))) + 1
            sizes.append(np.diff(ends, prepend=0))
        for i in np.flatnonzero(whole).tolist():
            ids.append(np.array(self.tool.encode(words[i], add_special_tokens=False).ids, np.int32))
            sizes.append(np.array([len(ids[-1])]))
        order = np.argsort(whole, kind="stable")
        found = np.concatenate(sizes)
        lengths, starts = np.empty_like(found), np.empty_like(found)
        lengths[order], starts[order] = found, np.cumsum(found) - found
        return chunks.ragged(np.concatenate(ids), starts, lengths), lengths

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each text closed by ``end``, and the number of ids of each."""
        pieces, at, counts = chunks.pieces(texts)
        words, parts, sizes = self._words(pieces)
        cache = self.cache
        numbers = cache.numbers(words)[parts]
        taken = cache.lengths[numbers]
        flat, lengths = chunks.ragged(cache.flat, cache.starts[numbers], taken), chunks.sums(taken, sizes)
        starts, lengths = (np.cumsum(lengths) - lengths)[at], lengths[at]
        body = chunks.ragged(flat, starts, lengths)
        each = chunks.sums(lengths, counts)
        out = np.insert(body, np.cumsum(each), end).astype(np.int32)
        cache.trim()
        return out, each + 1


def _encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def write_ids(
    docs: DataFrame, path: str, to: str, key: str = "doc_id", text: str = "text", end: int = 0, layout: OrcLayout = OrcLayout()
) -> None:
    """Write the token ids of ``docs`` to ORC files below ``to``, in ascending order of ``key``.

    Each row is one document: key, ``ids`` (with the end id), ``n`` (how many),
    ``part`` and ``seq`` (the file's number and the document's place in it) and
    ``at`` (the ids before it in the file). Texts are dealt out in ranges of the key, sorted there and
    encoded, so files follow one another in document order. Null texts count as
    empty: they hold the end id alone. A null key comes first. Equal keys are
    ordered by a hash of the text and then by the text; rows equal in both are
    interchangeable. Only key and text are read.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, seq, at = _encoder(path), TaskContext.get().partitionId(), 0, 0
        for frame in frames:
            row = 0
            for group in chunks.batches(frame.column(1).to_pylist()):
                flat, lengths = tool.encode(group, end)
                ends = np.concatenate(([0], np.cumsum(lengths)))
                yield pa.RecordBatch.from_arrays(
                    [
                        frame.column(0).slice(row, len(group)), pa.array(np.full(len(group), part), pa.int64()),
                        pa.array(np.arange(seq, seq + len(group)), pa.int64()), pa.array(at + ends[:-1], pa.int64()), pa.array(lengths, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())),
                    ],
                    ["k", "part", "seq", "at", "n", "ids"],
                )
                row, seq, at = row + len(group), seq + len(group), at + int(ends[-1])

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    spread = F.xxhash64("t")
    rows = rows.repartitionByRange("k", spread).sortWithinPartitions("k", spread, "t")
    coded = rows.mapInArrow(encode, f"k {kind}, part long, seq long, at long, n long, ids array<int>")
    coded.withColumnRenamed("k", key).write.mode("overwrite").options(**layout.options(key)).orc(to)


def read_ids(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """Documents of ``write_ids``: key, ids and ``start``, the number of ids of all documents before.

    Only one total per file is gathered, from one narrow column; there are at most
    as many files as shuffle partitions, which bounds what is broadcast. Within a
    file the stored place is used, so stripes are read independently, and a filter
    on the key is settled by statistics and Bloom filters of stripes and row groups.
    """
    rows = spark.read.orc(folder)
    last = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_file = rows.groupBy("part").agg(F.sum("n").alias("total"))
    starts = per_file.select("part", F.coalesce(F.sum("total").over(last), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(starts), "part").select(key, "ids", (F.col("before") + F.col("at")).alias("start"), "part", "seq")


def digests(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document of ``read_ids``: key, start, n_tokens and ids_crc32 of its ids as little-endian 32-bit integers."""
    kind = rows.select(key).schema[0].dataType.simpleString()

    def check(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            ids = frame.column(2)
            flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [frame.column(0), frame.column(1), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())],
                ["k", "start", "n_tokens", "ids_crc32"],
            )

    out = rows.select(F.col(key).alias("k"), "start", "ids").mapInArrow(check, f"k {kind}, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("k", key)
