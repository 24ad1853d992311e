"""Pre-tokens: pattern matches of whole texts, and a bounded cache that works on distinct ones.

Texts are cut into blocks only in front of white space that follows something
else. No match of the byte-level pattern reaches over such a place, so the
blocks give the matches of the whole text, and a very long text needs no more
memory than a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import regex

BLOCK_CHARS = 1 << 20
CACHE_WORDS = 1 << 18


def blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """The text in pieces that the pattern can treat one by one."""
    cut = regex.compile(r"(?<=\S)(?=\s)")
    start = 0
    while len(text) - start > size:
        found = cut.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


class Grown:
    """A numpy array that grows by doubling."""

    def __init__(self, dtype):
        self.data, self.n = np.empty(1024, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.data):
            more = np.empty(max(need, 2 * len(self.data)), self.data.dtype)
            more[: self.n] = self.data[: self.n]
            self.data = more
        self.data[self.n : need] = values
        self.n = need


class Numbered(dict):
    """Word to number; unseen words get the next one and wait in `fresh`."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class WordCache:
    """Results of distinct words, kept for at most `limit` words; the results may be ragged."""

    def __init__(self, solve: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = CACHE_WORDS):
        """solve: words to their flat values and the number of values of each."""
        self.solve, self.limit = solve, limit
        self._clear()

    def _clear(self) -> None:
        self.numbers = Numbered()
        self.flat, self.sizes, self.starts = Grown(np.int32), Grown(np.int64), Grown(np.int64)

    def look_up(self, words: list[list[str]]) -> list[np.ndarray]:
        """For each list of words the numbers of its words; valid until the next call of look_up."""
        if len(self.numbers) > self.limit:
            self._clear()
        get = self.numbers.__getitem__
        found = [np.fromiter(map(get, w), np.int64, len(w)) for w in words]
        if self.numbers.fresh:
            flat, sizes = self.solve([w.encode("utf-8", "surrogatepass") for w in self.numbers.fresh])
            self.starts.extend(self.flat.n + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64))
            self.sizes.extend(sizes)
            self.flat.extend(flat)
            self.numbers.fresh = []
        return found

    def values(self, numbers: np.ndarray) -> np.ndarray:
        """The values of the words, one after the other."""
        sizes = self.sizes.data[numbers]
        ends = np.cumsum(sizes)
        if not len(ends):
            return np.empty(0, np.int32)
        at = np.repeat(self.starts.data[numbers] - (ends - sizes), sizes)
        at += np.arange(ends[-1])
        return self.flat.data[at]
