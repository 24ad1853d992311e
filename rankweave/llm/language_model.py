"""An interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark and memory-mapped by the workers.

Tokens are words between ASCII white space with A to Z lower-cased, and one
end after the last. A text starts behind order - 1 begin marks that are never
scored.

The words are counted first: sorted hashes and counts in shards. A word's
number is its rank by count in its shard, so n-grams travel as small numbers,
sorted, as differences, compressed. Two shuffles follow. The first deals
n-grams by their last two words: a range adds up what tasks have counted and
has all that ends in its pairs, so it knows the count of each pair, which is
the number of different words before it (or all its occurrences behind a begin
mark, which nothing precedes). It writes sorted hashes and counts of n-grams
and pairs to the model folder. The second brings each pair and each word what
it needs as a context, the sum of the counts behind it and how many followers
have one, two and more, and each word the number of different words before
it. No n-gram travels more than once a block of a task, so a word or pair that
is a third of all tokens is like any other, and what ends in one pair is at
most one n-gram a different word. The number of ranges follows the bytes of
the texts, `RANGE_BYTES` for each. Longer n-grams would need one more deal a
length and are refused.

Scoring looks the n-grams of a block of texts up in the memory-mapped ranges.
For a context h, h' without its first word, a(hw) the count above, D the
discounts from the counts of counts of this length, V different tokens,

    P(w | h) = (a(hw) - D(a)) / a(h.) + g(h) P(w | h')
    P(w)     = (a(w) - D(a)) / a(.) + g / (V + 1)

and g gives back what was discounted. A word never seen has a = 0; behind a
context never seen P(w | h') alone counts. The probabilities of the V tokens
and of one unknown token add up to 1.

The model folder is one that all workers reach (see `shards`). Every range has
its files, empty ones too, and a worker that doesn't find one raises an error.
Null texts are empty: their only token is the end. Without training rows every
token has probability 1. Equal rows count as often as they occur. Columns of
df that are named like the new ones are replaced; others pass through.

Words are known by 56 bits of a hash: two of V words share one with a
probability of about V * V / 2**57, one in 10**5 for a million words. Of an
n-gram's 64 bits a range keeps 32 behind those that its directory tells; with
some 32 entries a place of the directory one absent n-gram in 10**8 is taken
for another.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm import shards
from rankweave.llm.scratch import free_name, text_of

ORDER = 3
WORD_BITS = 56  # hashes of words travel in seven bytes
END = np.uint64(xxhash.xxh64_intdigest(b"", 0) >> 8)
BEGIN = np.uint64(xxhash.xxh64_intdigest(b"", 1) >> 8)
UNKNOWN = np.uint64(1 << 63)  # the number of a word that no training text has
CHUNK = 1 << 21
RANGE_BYTES = 16 << 20  # of text
CODEC = pa.Codec("zstd", 3)


def tokens(text: str | None) -> list[bytes]:
    """The words: bytes lower-case ASCII letters only and split at ASCII white space only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(text: str | None) -> np.ndarray:
    """56-bit hashes of the words and of the end."""
    words = tokens(text)
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out[:-1] >>= np.uint64(8)
    out[-1] = END
    return out


def gram_keys(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """64-bit hashes of n-grams of word numbers, two words at least; so many leading bits are of the last two words."""
    mixed = np.full(len(columns[0]), len(columns), np.uint64)
    for column in columns:
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + column
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    if len(columns) == 2:
        return mixed
    below = np.uint64(64 - bits)
    return (gram_keys(columns[-2:], bits) >> below << below) | (mixed >> np.uint64(bits))


def _seven(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _eight(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 7, 8), np.uint8)
    wide[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return wide.view("<u8").ravel()


def _packed(columns: list[np.ndarray], sums: list[np.ndarray]) -> bytes:
    """Rows sorted by their last words, these as differences; bytes of one weight together, without leading zeros."""
    near = np.zeros(len(sums[0]), np.uint64)
    for column in columns:
        near = (near >> np.uint64(21)) | (column << np.uint64(42))
    order = np.argsort(near)
    parts = [np.array([len(order)], "<u8").tobytes()]
    for j, values in enumerate([*reversed(columns), *sums]):
        values = values[order].astype(np.int64)
        if j < min(2, len(columns)):
            values = np.diff(values, prepend=np.int64(0))
            values = (values << 1) ^ (values >> 63)
        planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
        width = max(i + 1 for i in range(8) if i == 0 or planes[i].any())
        parts += [bytes([width]), planes[:width].tobytes()]
    plain = b"".join(parts)
    return len(plain).to_bytes(8, "little") + CODEC.compress(plain, asbytes=True)


def _unpacked(data: bytes, length: int, n_sums: int) -> list[np.ndarray]:
    """Columns and sums that _packed had."""
    plain = CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    n, at, found = int.from_bytes(plain[:8], "little"), 8, []
    for j in range(length + n_sums):
        width = plain[at]
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(plain, np.uint8, width * n, at + 1).reshape(width, n).T
        values = wide.view("<i8").ravel()
        if j < min(2, length):
            values = np.cumsum((values >> 1) ^ -(values & 1))
        found.append(values)
        at += 1 + width * n
    return [c.view(np.uint64) for c in reversed(found[:length])] + found[length:]


def _added(keys: np.ndarray, columns: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct keys, rising, with their columns and the sums of the values."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], [c[order[first]] for c in columns], [np.add.reduceat(v[order], first) if len(keys) else v[order] for v in sums]


def _ranges(keys: np.ndarray, bits: int, width: int) -> Iterator[tuple[int, slice]]:
    """Of rising keys of so many bits the slices by their leading bits."""
    edges = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(width - bits))
    edges = np.r_[edges, len(keys)]
    for k in np.flatnonzero(np.diff(edges)):
        yield int(k), slice(edges[k], edges[k + 1])


def _save_keys(folder: str, name: str, keys: np.ndarray, bits: int) -> None:
    """Of rising keys of one range the edges of a directory and the 32 bits behind it."""
    wide = max(0, min(len(keys).bit_length() - 5, 32 - bits))
    places = (keys << np.uint64(bits)) >> np.uint64(32)
    edges = np.searchsorted(places, np.arange((1 << wide) + 1, dtype=np.uint64) << np.uint64(32 - wide))
    shards.save(folder, name, edges.astype(np.int64), ((keys << np.uint64(bits + wide)) >> np.uint64(32)).astype(np.uint32))


def _find(folder: str, name: str, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Which of the keys the range has, where, and how many it has."""
    edges, rest = shards.load(folder, name, 2)
    if not len(rest):
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    wide = (len(edges) - 1).bit_length() - 1
    place = ((keys << np.uint64(bits)) >> np.uint64(64 - wide)).astype(np.int64) if wide else np.zeros(len(keys), np.int64)
    want = ((keys << np.uint64(bits + wide)) >> np.uint64(32)).astype(np.uint32)
    low, end = np.asarray(edges)[place], np.asarray(edges)[place + 1]
    high = end
    for _ in range(int((high - low).max(initial=0)).bit_length()):
        middle = (low + high) >> 1
        less = (low < high) & (rest[np.minimum(middle, len(rest) - 1)] < want)
        low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
    hit = np.flatnonzero((low < end) & (rest[np.minimum(low, len(rest) - 1)] == want))
    return hit, low[hit], len(rest)


def _save_numbers(folder: str, name: str, numbers: np.ndarray) -> None:
    """Numbers in a byte each; those of 255 or more with their places besides."""
    flat = numbers.ravel()
    large = np.flatnonzero(flat >= 255)
    shards.save(folder, name, np.stack([large, flat[large]]).astype(np.int64), np.minimum(flat, 255).astype(np.uint8))


def _numbers(folder: str, name: str, at: np.ndarray) -> np.ndarray:
    """The saved numbers at these places."""
    large, flat = shards.load(folder, name, 2)
    n = flat[at].astype(np.int64)
    over = np.flatnonzero(n == 255)
    if len(over):
        n[over] = large[1][np.searchsorted(large[0], at[over])]
    return n


@dataclass
class Model:
    folder: str
    order: int
    bits: int  # leading ones that tell the range of an n-gram
    word_bits: int
    discounts: dict[int, tuple[float, float, float]]  # by length
    pair_types: int
    train_tokens: int
    vocabulary: int
    left_over: float  # the share that single words give to the uniform level


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from counts of counts; plain values where the counts are too few."""
    if not (n1 and n2 and n3):
        return (0.5, 1.0, 1.5)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def _known(folder: str, word_bits: int, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rising word hashes by shards: the shard, which are in it, their occurrences and their ranks."""
    for part, s in _ranges(words, word_bits, WORD_BITS):
        stored, n, ranks = shards.load(folder, f"words-{part}", 3)
        if len(stored):
            at = np.minimum(np.searchsorted(stored, words[s]), len(stored) - 1)
            hit = np.flatnonzero(stored[at] == words[s])
            yield part, hit + s.start, n[at[hit]], ranks[at[hit]].astype(np.uint64)


def word_numbers(folder: str, word_bits: int, hashes: np.ndarray) -> np.ndarray:
    """Numbers of words, UNKNOWN where no training text has them."""
    words, back = np.unique(hashes, return_inverse=True)
    numbers = np.full(len(words), UNKNOWN)
    for part, hit, _, ranks in _known(folder, word_bits, words):
        numbers[hit] = (ranks << np.uint64(word_bits)) | np.uint64(part)
    return numbers[back]


def _padded(values: np.ndarray, sizes: np.ndarray, begin: int, marks: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts of these sizes, each behind so many begin marks, and where their tokens are."""
    at = np.arange(len(values)) + marks * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    padded = np.full(len(values) + marks * len(sizes), begin, values.dtype)
    padded[at] = values
    return padded, at


def _texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[np.ndarray]]:
    """Word hashes of texts in lists of about so many tokens."""
    held, size = [], 0
    for batch in batches:
        for text in batch.column(0):
            held.append(word_hashes(text.as_py()))
            size += len(held[-1])
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _count_words(texts: DataFrame, folder: str, word_bits: int) -> tuple[int, int]:
    """Write the words; number of tokens and of different ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)) >> np.uint64(8)
            hashes, n = np.r_[hashes, END], np.r_[np.fromiter(found.values(), np.int64, len(found)), ends]
            hashes, _, (n,) = _added(hashes, [], [n])
            rows = [(k, _seven(hashes[s]), n[s].astype("<u8").tobytes()) for k, s in _ranges(hashes, word_bits, WORD_BITS)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], names=["part", "words", "n"])

        found, ends, size = Counter(), 0, 0
        for batch in batches:
            for text in batch.column(0):
                words = tokens(text.as_py())
                found.update(words)
                ends += 1
                size += len(words)
                if size >= CHUNK:
                    yield block()
                    found, ends, size = Counter(), 0, 0
        if ends:
            yield block()

    def store(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        hashes = np.concatenate([_eight(b.as_py()) for b in table.column("words")])
        n = np.concatenate([np.frombuffer(b.as_py(), "<u8").astype(np.int64) for b in table.column("n")])
        hashes, _, (n,) = _added(hashes, [], [n])
        ranks = np.empty(len(n), np.uint32)
        ranks[np.argsort(-n, kind="stable")] = np.arange(len(n), dtype=np.uint32)
        shards.save(folder, f"words-{part}", hashes, n, ranks)
        return pa.table({"tokens": pa.array([int(n.sum())], pa.int64()), "types": pa.array([int((n > 0).sum())], pa.int64())})

    # an empty block for every shard, so that each one writes its file; the begin mark is a word that never occurs
    spark = texts.sparkSession
    own = F.col("id") == (int(BEGIN) >> (WORD_BITS - word_bits))
    empty = spark.range(1 << word_bits).select(F.col("id").cast("int").alias("part"), F.when(own, F.lit(_seven(np.array([BEGIN])))).otherwise(F.lit(b"")).alias("words"), F.when(own, F.lit(bytes(8))).otherwise(F.lit(b"")).alias("n"))
    counted = texts.mapInArrow(count, "part int, words binary, n binary").unionByName(empty)
    facts = counted.repartitionById(1 << word_bits, F.col("part")).groupBy("part").applyInArrow(store, "tokens long, types long")
    return facts.agg(F.sum("tokens"), F.sum("types")).head()


#: kind: n-grams, pairs as contexts, words as last ones, words as contexts, and counts of counts on their way to the driver
BLOCKS = "part int, kind int, data binary"
GRAM, PAIR_CONTEXT, WORD, WORD_CONTEXT, FACTS = range(5)


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows], pa.int32()), "data": pa.array([r[2] for r in rows], pa.binary())})


def _blocks(kind: int, keys: np.ndarray, columns: list[np.ndarray], sums: list[np.ndarray], bits: int, first: int = 0) -> list[tuple[int, int, bytes]]:
    return [(first + k, kind, _packed([c[s] for c in columns], [v[s] for v in sums])) for k, s in _ranges(keys, bits, 64)]


def _merged(table: pa.Table, kind: int, length: int, n_sums: int, key) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """All blocks of a kind, added up by the key of their columns."""
    blocks = [_unpacked(d.as_py(), length, n_sums) for k, d in zip(table.column("kind").to_pylist(), table.column("data"), strict=True) if k == kind and len(d.as_py())]
    wide = [np.concatenate(c) for c in zip(*blocks, strict=True)] or [np.empty(0, np.uint64)] * length + [np.empty(0, np.int64)] * n_sums
    del blocks
    return _added(key(wide[:length]), wide[:length], wide[length:])


def _followers(n: np.ndarray) -> list[np.ndarray]:
    """What each n-gram adds to its context: the sum, and followers with one, two and more."""
    once, twice = (n == 1).astype(np.int64), (n == 2).astype(np.int64)
    return [n, once, twice, 1 - once - twice]


def _of_counts(n: np.ndarray) -> list[int]:
    return [*((n == k).sum() for k in (1, 2, 3, 4)), len(n), n.sum()]


def fit(df: DataFrame, text_col: str = "text", model_dir: str | None = None, range_bytes: int = RANGE_BYTES, order: int = ORDER) -> Model:
    """Count all texts of df, which are read three times: for their bytes, their words and their n-grams of this order, 2 or 3."""
    if order not in (2, 3):
        raise ValueError(f"order must be 2 or 3, not {order}")
    spark = df.sparkSession
    folder = shards.new_folder(spark, "language-model", model_dir)
    texts = df.select(text_of(text_col).alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bits = max(3, (n_bytes // range_bytes).bit_length())
    word_bits = max(3, bits - 3)
    train_tokens, vocabulary = _count_words(texts, folder, word_bits)

    def begin_mark() -> np.uint64:
        return word_numbers(folder, word_bits, np.array([BEGIN]))[0]

    def gram_key(columns: list[np.ndarray]) -> np.ndarray:
        return gram_keys(columns, bits)

    def word_key(columns: list[np.ndarray]) -> np.ndarray:  # the shard comes first, then the rank
        return (columns[0] << np.uint64(64 - word_bits)) | (columns[0] >> np.uint64(word_bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = begin_mark()
        for held in _texts(batches, CHUNK):
            padded, at = _padded(word_numbers(folder, word_bits, np.concatenate(held)), np.array([len(h) for h in held]), begin, order - 1)
            columns = [padded[at - back] for back in range(order - 1, -1, -1)]
            keys, columns, n = _added(gram_key(columns), columns, [np.ones(len(at), np.int64)])
            yield from _table(_blocks(GRAM, keys, columns, n, bits)).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        part, facts, rows = table.column("part")[0].as_py(), np.zeros((4, 6), np.int64), []
        keys, columns, (n,) = _merged(table, GRAM, order, 1, gram_key)
        begin = begin_mark()
        if order == 3:
            facts[3] = _of_counts(n)
            _save_keys(folder, f"3-{part}", keys, bits)
            _save_numbers(folder, f"3-{part}-n", n)
            contexts = _added(gram_key(columns[:2]), columns[:2], _followers(n))
            rows += _blocks(PAIR_CONTEXT, *contexts, bits)
            keys, columns, (n,) = _added(gram_key(columns[1:]), columns[1:], [np.where(columns[1] == begin, n, 1)])
        facts[2] = _of_counts(n)
        # two begin marks are a context that is no pair of the texts
        marks = gram_key([np.array([begin])] * 2)
        own = marks if order == 3 and int(marks[0]) >> (64 - bits) == part else marks[:0]
        every = np.insert(keys, np.searchsorted(keys, own), own)
        numbers = np.zeros(len(every), np.int64)
        numbers[np.searchsorted(every, keys)] = n
        _save_keys(folder, f"2-{part}", every, bits)
        _save_numbers(folder, f"2-{part}-n", numbers)
        rows += _blocks(WORD, *_added(word_key(columns[1:]), columns[1:], [np.ones_like(n)]), word_bits, 1 << bits)
        rows += _blocks(WORD_CONTEXT, *_added(word_key(columns[:1]), columns[:1], _followers(n)), word_bits, 1 << bits)
        return _table([*rows, (part, FACTS, facts.tobytes())])

    def store(table: pa.Table) -> pa.Table:
        place, facts = table.column("part")[0].as_py(), np.zeros((4, 6), np.int64)
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data"), strict=True):
            if kind == FACTS and len(data.as_py()):
                facts += np.frombuffer(data.as_py(), "<i8").reshape(4, 6)
        if place < 1 << bits:
            keys, _, sums = _merged(table, PAIR_CONTEXT, 2, 4, gram_key)
            hit, at, size = _find(folder, f"2-{place}", keys, bits)
            numbers = np.zeros((4, size), np.int64)
            numbers[:, at] = np.stack(sums)[:, hit]
            _save_numbers(folder, f"2-{place}-context", numbers)
        else:
            part = place - (1 << bits)
            # a word's numbers lie by its rank
            numbers = np.zeros((5, len(shards.load(folder, f"words-{part}", 3)[0])), np.int64)
            _, (words,), (n,) = _merged(table, WORD, 1, 1, word_key)
            numbers[0, (words >> np.uint64(word_bits)).astype(np.int64)] = n
            _, (words,), sums = _merged(table, WORD_CONTEXT, 1, 4, word_key)
            numbers[1:, (words >> np.uint64(word_bits)).astype(np.int64)] = sums
            facts[1] = _of_counts(n)
            shards.save(folder, f"1-{part}", numbers)
        return pa.table({"length": pa.array(range(4), pa.int32()), **{f"f{i}": pa.array(facts[:, i], pa.int64()) for i in range(6)}})

    # an empty block for every range, so that each one writes its files; a range is a partition
    def empty(parts: int) -> DataFrame:
        return spark.range(parts).select(F.col("id").cast("int").alias("part"), F.lit(FACTS).alias("kind"), F.lit(b"").alias("data"))

    places = (1 << bits) + (1 << word_bits)
    counted = texts.mapInArrow(count, BLOCKS).unionByName(empty(1 << bits))
    sums = counted.repartitionById(1 << bits, F.col("part")).groupBy("part").applyInArrow(merge, BLOCKS).unionByName(empty(places))
    facts = sums.repartitionById(places, F.col("part")).groupBy("part").applyInArrow(store, "length int, " + ", ".join(f"f{i} long" for i in range(6)))
    total = {r["length"]: r[1:] for r in facts.groupBy("length").agg(*(F.sum(f"f{i}").alias(f"f{i}") for i in range(6))).collect()}
    d = {k: discounts(*total[k][:4]) for k in range(1, order + 1)}
    n1, n2, _, _, types, pair_types = total[1]
    left_over = (d[1][0] * n1 + d[1][1] * n2 + d[1][2] * (types - n1 - n2)) / pair_types if pair_types else 1.0
    return Model(folder, order, bits, word_bits, d, pair_types, train_tokens, vocabulary, left_over)


class Scorer:
    """Looks words and n-grams up in the mapped ranges of a model."""

    def __init__(self, model: Model):
        self.model = model

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rising word hashes the numbers, and occurrences, count as last word and four sums as a context."""
        m = self.model
        numbers, out = np.full(len(hashes), UNKNOWN), np.zeros((6, len(hashes)), np.int64)
        for part, hit, n, ranks in _known(m.folder, m.word_bits, hashes):
            numbers[hit] = (ranks << np.uint64(m.word_bits)) | np.uint64(part)
            (stored,) = shards.load(m.folder, f"1-{part}", 1)
            out[0, hit], out[1:, hit] = n, stored[:, ranks.astype(np.int64)]
        return numbers, out

    def grams(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of n-grams the count and, if shorter than the order, four sums as a context: one column a different one, and whose it is."""
        m, length = self.model, len(columns)
        keys, back = np.unique(gram_keys(columns, m.bits), return_inverse=True)
        out = np.zeros((1 if length == m.order else 5, len(keys)), np.int64)
        for part, s in _ranges(keys, m.bits, 64):
            hit, at, size = _find(m.folder, f"{length}-{part}", keys[s], m.bits)
            out[0, hit + s.start] = _numbers(m.folder, f"{length}-{part}-n", at)
            for c in range(len(out) - 1):
                out[1 + c, hit + s.start] = _numbers(m.folder, f"{length}-{part}-context", at + c * size)
        return out, back

    def score(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For texts as word hashes: tokens, known tokens, base score and score."""
        m = self.model
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes) - sizes
        padded, at = _padded(np.concatenate(texts), sizes, BEGIN, m.order - 1)
        words, back = np.unique(padded, return_inverse=True)
        numbers, found = self.words(words)
        numbers, known, last = numbers[back], found[0] > 0, back[at]
        base = np.log10((found[0] + 1.0) / (m.train_tokens + m.vocabulary + 1.0))
        p = ((found[1] - self._discount(found[1], m.discounts[1])) / max(m.pair_types, 1) + m.left_over / (m.vocabulary + 1.0))[last]
        contexts, context = found[2:], back
        for length in range(2, m.order + 1):
            # n-grams end at all places that have so many words; the one that ends a place earlier is the context
            grams, of_gram = self.grams([numbers[i : len(numbers) - length + 1 + i] for i in range(length)])
            d, total = m.discounts[length], np.maximum(contexts[0], 1)
            rest = np.where(contexts[0] > 0, (d[0] * contexts[1] + d[1] * contexts[2] + d[2] * contexts[3]) / total, 1.0)
            before = context[at - 1 - (length - 2)]
            own = of_gram[at - (length - 1)]
            p = (grams[0] - self._discount(grams[0], d))[own] / total[before] + rest[before] * p
            contexts, context = grams[1:], of_gram
        return sizes, np.add.reduceat(known[last].astype(np.int64), starts), np.add.reduceat(base[last], starts), np.add.reduceat(np.log10(p), starts)

    @staticmethod
    def _discount(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        return np.array([0.0, *d])[np.minimum(n, 3)]


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df without its text, with n_tokens, n_known, base_score and score (log10)."""
    new = ("n_tokens", "n_known", "base_score", "score")
    others = [f for f in df.schema.fields if f.name not in (text_col, *new)]
    schema = T.StructType([*others, T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            at = batch.num_columns - 1
            start, size, held = 0, 0, []
            for row in range(batch.num_rows):
                held.append(word_hashes(batch.column(at)[row].as_py()))
                size += len(held[-1])
                if size >= CHUNK or row == batch.num_rows - 1:
                    part = batch.slice(start, len(held))
                    n, known, base, own = scorer.score(held)
                    columns = [part.column(i) for i in range(part.num_columns) if i != at]
                    columns += [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                    start, size, held = row + 1, 0, []

    return df.select(*[df[f"`{f.name}`"] for f in others], df[f"`{text_col}`"].alias(free_name(df, "__text"))).mapInArrow(run, schema)


def perplexity(score_col: Column, tokens_col: Column) -> Column:
    return F.pow(F.lit(10.0), -score_col / tokens_col)
