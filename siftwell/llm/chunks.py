"""Pieces of a text that a byte-level tokenizer treats alone, with results kept per piece.

Such a tokenizer cuts a text before every space that a character other than
white space follows; no token crosses the cut and nothing before it changes
what comes after. So a text is the sum of its pieces, and a piece that occurs
again need not be tokenized again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# Fixed value: the pattern that splits a text before the merges of a byte-level vocabulary.
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in a vocabulary file: itself where printable, else the next free letter from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    return letters | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}


def any_of(strings: Iterable[str]) -> regex.Pattern | None:
    """Pattern of the given strings, longer ones first; None if there are none."""
    strings = sorted(strings, key=len, reverse=True)
    return regex.compile("|".join(map(regex.escape, strings))) if strings else None


class PieceCache(dict):
    """Number by string, numbered as they come; new ones wait until ``settle``.

    ``solve(strings)`` returns one array of ints per string, end to end, with their
    lengths. Once the cache holds ``limit`` characters it starts anew between
    batches and keeps what it had as a second generation, from which strings that
    come again are taken over; so memory is bounded whatever the number of
    distinct strings, and frequent ones stay.
    """

    def __init__(self, solve: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 16_000_000):
        super().__init__()
        self.solve, self.limit = solve, limit
        self.before: dict = {}
        self._start()

    def _start(self) -> None:
        self.clear()
        self._wait()
        self.held = 0
        self.flat = np.empty(0, np.int32)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)

    def _wait(self) -> None:
        self.new: list[str] = []
        self.add = self.new.append

    def __missing__(self, string: str) -> int:
        n = self[string] = len(self)
        self.add(string)
        return n

    def numbers(self, strings: pa.Array) -> np.ndarray:
        """Numbers of the given strings, all settled."""
        out = np.fromiter(map(self.__getitem__, strings.to_numpy(zero_copy_only=False).tolist()), np.int64, len(strings))
        self.settle()
        return out

    def settle(self) -> None:
        """Solve the strings that wait, or take them over from the generation before."""
        if not self.new:
            return
        known = np.fromiter(map(self.before.get, self.new, repeat(-1)), np.int64, len(self.new))
        fresh = [s for s, n in zip(self.new, known.tolist()) if n < 0] if self.before else self.new
        self.held += 50 * len(self.new) + sum(map(len, self.new))
        flat, solved = self.solve(fresh) if fresh else (self.flat[:0], self.lengths[:0])
        old = known[known >= 0]
        lengths = np.empty(len(known), np.int64)
        starts = np.empty(len(known), np.int64)
        lengths[known < 0] = solved
        starts[known < 0] = len(self.flat) + np.cumsum(solved) - solved
        if len(old):
            taken = self.past_lengths[old]
            lengths[known >= 0] = taken
            starts[known >= 0] = len(self.flat) + len(flat) + np.cumsum(taken) - taken
            flat = np.concatenate((flat, ragged(self.past_flat, self.past_starts[old], taken)))
        self.flat = np.concatenate((self.flat, flat))
        self.starts = np.concatenate((self.starts, starts))
        self.lengths = np.concatenate((self.lengths, lengths))
        self._wait()

    def trim(self) -> None:
        """Call between batches."""
        if self.held > self.limit:
            self.before = dict(self)
            self.past_flat, self.past_starts, self.past_lengths = self.flat, self.starts, self.lengths
            self._start()


def batches(texts: Iterable[str | None], size: int = 2_000_000) -> Iterable[list[str]]:
    """Texts in lists of about ``size`` characters; null becomes empty. A longer text is a list of its own."""
    group, held = [], 0
    for text in texts:
        text = text or ""
        if group and held + len(text) > size:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``flat[s:s + n]`` end to end."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def pieces(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pieces of a batch, for each piece of each text its place among them, and how many each text has.

    Arrow splits the texts at every space and numbers the distinct parts, so what is
    done with a piece is done once however often the texts hold it. A part that is empty or
    begins with white space starts no piece and is put back behind the part before it.
    """
    parts = pc.split_pattern(pa.array(texts, pa.string()), " ")
    ends, coded = parts.offsets.to_numpy(), parts.values.dictionary_encode()
    distinct, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    head = np.zeros(len(at), bool)  # the part before a text's first space
    head[ends[:-1]] = True
    inner = pc.or_(pc.equal(distinct, ""), pc.utf8_is_space(pc.utf8_slice_codeunits(distinct, 0, 1))).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(head | ~inner[at])
    size = np.diff(first, append=len(at))
    apart = head[first] | (size > 1)
    led = np.zeros(len(distinct), bool)
    led[at[first[~apart]]] = True
    numbers = np.empty(len(first), np.int64)
    numbers[~apart] = (np.cumsum(led) - 1)[at[first[~apart]]]
    numbers[apart] = led.sum() + np.arange(apart.sum())
    own = parts.values.filter(pa.array(np.repeat(apart, size))).to_pylist()
    stop = np.cumsum(size[apart])
    others = [("" if leads else " ") + " ".join(own[a:b]) for a, b, leads in zip((stop - size[apart]).tolist(), stop.tolist(), head[first[apart]].tolist())]
    found = pa.concat_arrays([pc.binary_join_element_wise(" ", distinct.filter(pa.array(led)), ""), pa.array(others, pa.string())])
    return found, numbers, np.bincount(np.cumsum(head)[first] - 1, minlength=len(texts))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``counts`` values; 0 for an empty run."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
