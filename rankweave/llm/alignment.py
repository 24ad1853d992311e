"""Alignment of two tokenizations of a text, and how often ids of both are linked in the corpus.

Both tokenizers see the text behind a space. Byte offsets where tokens of both
end are cuts. They are found by divide and conquer: an interval of tokens that
both sides cover is searched from its middle outwards, each end of side A by
bisection among the ends of side B; the nearest common end cuts it in two, and
both halves are searched in the same way. Intervals without a common end inside
are the groups. All intervals of a depth and of many texts are searched at once
in numpy, so that a step costs no Python call for a token.

Tokens come from the libraries. Words of a text (cut before a space that
follows something visible, where neither vocabulary has a token that reaches
over) are tokenized once while a bounded cache holds them.

A link is a pair of occurrences, one of each side, in one group. A text's links
travel as its distinct id pairs with their number: in a group of x and y ids
only distinct ones are multiplied, in blocks of `BLOCK` pairs. A text with more
pairs than a block becomes several rows (part of parts), each with all pairs of
its A ids. Counts over the corpus are grouped by pair in Spark (tasks combine
their own first), dealt into shards by the A id, so that an id's highest count
is known there, and written as sorted arrays that workers map (`shards`). Texts
look their pairs up in them; no link is joined. A shard's size is bounded by
the vocabularies: an A id has at most as many partners as B has ids.

Null and empty texts, and texts whose tokens of either side don't give back the
text's bytes, have no tokens: zeros and no groups. A very long text is cut into
words like others; its tokens are held once. Rows that repeat an id or a text
are documents of their own, and count as such. An empty table gives an empty
result. Other columns pass through under any name, in one struct `row`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm import shards
from rankweave.llm.pretoken import Grown, Numbered
from rankweave.llm.scratch import discard, text_of, written
from rankweave.llm.token_count import Merges, byte_letters

#: A word goes on behind a space that doesn't follow something visible: white, control and unassigned characters aren't.
WORD = regex.compile(r" +[^ ]*(?:(?<=[\s\p{Z}\p{C}]) +[^ ]*)*")
#: Where no text has such a place, words are what stands between spaces.
ODD = re.compile(r"  |[^\w!-/:-@\[-`{-~] |^ ")
#: Between words of a group: spaces that a word begins with, or that follow something not visible.
UNSEEN = regex.compile(r"^ |^$|(?<=[\s\p{Z}\p{C}]) | $")
BAD = -1  # stands for a word whose tokens don't give back its bytes
CACHE_WORDS = 1 << 18
BLOCK = 1 << 21  # id pairs that are worked on at once
SLICE = 1 << 19  # bytes of text that are aligned at once
TOGETHER = 128  # words that the libraries get as one text
LONG = 8192  # longer texts of words go to them one by one
ID_BITS = 21
SHARD_PAIRS = 1 << 18


def words_of(text: str) -> list[str]:
    """The words of a text behind a space, each without the space that it begins with."""
    if not text:
        return []
    if ODD.search(text):
        return [w[1:] for w in WORD.findall(" " + text)]
    return text.split(" ")


class ByteLevel:
    """A byte-level BPE file of the tokenizers library; special tokens' strings are plain text."""

    def __init__(self, content: bytes, pattern: str):
        self.tokenizer = tokenizers.Tokenizer.from_str(content.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        byte = {ord(c): b for b, c in enumerate(byte_letters())}
        self.bytes = {i: bytes(byte[ord(c)] for c in t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if all(ord(c) in byte for c in t)}
        # the same merges by rank, where ids rise with them: tiktoken is faster on ordinary words
        merged = Merges(content, pattern).made
        if (np.diff(merged) <= 0).any():
            raise ValueError("ids of merged tokens must rise with their rank")
        used = {*merged.tolist(), *(i for i, b in self.bytes.items() if len(b) == 1)}
        self.ranks = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={b: i for i, b in self.bytes.items() if i in used}, special_tokens={})

    def encode(self, words: list[str]) -> list[int]:
        """Ids of the words one behind the other."""
        text = " " + " ".join(words)
        if len(text) > LONG:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(text)


class Pieces:
    """A sentencepiece model, which adds a space to what it reads."""

    def __init__(self, content: bytes):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=content)
        p = self.processor
        pieces = [(i, p.id_to_piece(i)) for i in range(p.get_piece_size())]
        if any("▁" in piece.lstrip("▁") for _, piece in pieces):
            raise ValueError("a piece has a space inside: words can't be tokenized one by one")
        self.bytes = {i: bytes([int(piece[3:5], 16)]) if p.is_byte(i) else piece.replace("▁", " ").encode() for i, piece in pieces}

    def encode(self, words: list[str]) -> list[int]:
        """Ids of the words one behind the other; the model adds no space to nothing."""
        text = " ".join(words)
        return self.processor.encode(text) if text else [self.processor.piece_to_id("▁")]


class Side:
    """Ids of words by one tokenizer, and the bytes of its tokens."""

    def __init__(self, path: str, content: bytes, pattern: str):
        self.tokenizer = Pieces(content) if path.endswith(".model") else ByteLevel(content, pattern)
        self.size = max(self.tokenizer.bytes) + 1
        self.length = np.zeros(self.size + 1, np.int32)  # one more for BAD
        self.length[list(self.tokenizer.bytes)] = [len(b) for b in self.tokenizer.bytes.values()]

    def solve(self, groups: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words and the number of ids of each; a group goes to the library as one text and is cut by its bytes."""
        token, flat, sizes = self.tokenizer.bytes, [], []
        for words in groups:
            ids = self.tokenizer.encode(words)
            whole = " ".join(["", *words]).encode("utf-8", "surrogatepass")
            if b"".join(map(token.__getitem__, ids)) == whole:
                ends = np.cumsum([len(w.encode("utf-8", "surrogatepass")) + 1 for w in words])
                got = np.cumsum(self.length[ids])
                at = np.searchsorted(got, ends)
                if (got[at] == ends).all():
                    flat.extend(ids)
                    sizes.append(np.diff(at, prepend=-1))
                    continue
            for word in words:  # some word isn't given back: which one?
                ids = self.tokenizer.encode([word])
                ids = ids if b"".join(map(token.__getitem__, ids)) == b" " + word.encode("utf-8", "surrogatepass") else [BAD]
                flat.extend(ids)
                sizes.append([len(ids)])
        return np.array(flat, np.int32), np.concatenate([*sizes, np.empty(0, np.int64)]).astype(np.int64)


class Ragged:
    """Lists of numbers, one behind the other."""

    def __init__(self):
        self.flat, self.sizes, self.starts = Grown(np.int32), Grown(np.int64), Grown(np.int64)

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.starts.extend(self.flat.n + np.cumsum(sizes) - sizes)
        self.sizes.extend(sizes)
        self.flat.extend(flat)

    def take(self, at: np.ndarray) -> np.ndarray:
        n = self.sizes.data[at]
        return self.flat.data[np.repeat(self.starts.data[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].astype(np.int64)


class Words:
    """Distinct words with their ids of both sides, emptied when there are more than `limit`."""

    def __init__(self, *sides: Side, limit: int = CACHE_WORDS):
        self.sides, self.limit = sides, limit
        self._clear()

    def _clear(self) -> None:
        self.numbers, self.ids = Numbered(), [Ragged() for _ in self.sides]

    def look_up(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side flat ids of texts given as words, and the number of ids of each text."""
        if len(self.numbers) > self.limit:
            self._clear()
        get = self.numbers.__getitem__
        found = np.fromiter((get(w) for t in texts for w in t), np.int64, sum(map(len, texts)))
        fresh, self.numbers.fresh = self.numbers.fresh, []
        groups = []
        for i in range(0, len(fresh), TOGETHER):
            group = fresh[i : i + TOGETHER]
            text = " ".join(group)
            apart = len(text) > LONG or UNSEEN.search(text) is not None
            groups += [[w] for w in group] if apart else [group]
        out, owner = [], np.repeat(np.arange(len(texts)), list(map(len, texts)))
        for side, ids in zip(self.sides, self.ids, strict=True):
            ids.extend(*side.solve(groups))
            out.append((ids.take(found), np.bincount(owner, ids.sizes.data[found], len(texts)).astype(np.int64)))
        return out


@lru_cache(maxsize=2)
def words_by(a_path: str, a_content: bytes, b_path: str, b_content: bytes, pattern: str) -> Words:
    """One cache for the tasks of a worker."""
    return Words(Side(a_path, a_content, pattern), Side(b_path, b_content, pattern))


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray, a_edges: np.ndarray, b_edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in rising a_ends and b_ends of all common ends, rising.

    The edges cut both into texts; the last ends of a text are common.
    """
    lo, hi, b_lo, b_hi = a_edges[:-1], a_edges[1:], b_edges[:-1], b_edges[1:]
    some = hi > lo
    lo, hi, b_lo, b_hi = lo[some], hi[some], b_lo[some], b_hi[some]
    cuts_a, cuts_b = [hi - 1], [b_hi - 1]
    while True:
        inner = (hi - lo > 1) & (b_hi - b_lo > 1)
        lo, hi, b_lo, b_hi = lo[inner], hi[inner], b_lo[inner], b_hi[inner]
        if not len(lo):
            break
        at_a, at_b = _nearest_the_middle(a_ends, b_ends, lo, hi)
        cut = at_a >= 0  # the others are leaves
        lo, hi, b_lo, b_hi, at_a, at_b = lo[cut], hi[cut], b_lo[cut], b_hi[cut], at_a[cut], at_b[cut]
        cuts_a.append(at_a)
        cuts_b.append(at_b)
        lo, hi = np.r_[lo, at_a + 1], np.r_[at_a + 1, hi]
        b_lo, b_hi = np.r_[b_lo, at_b + 1], np.r_[at_b + 1, b_hi]
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


def _nearest_the_middle(a_ends: np.ndarray, b_ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For intervals of A tokens the inner common end that is nearest to the middle, -1 where there is none.

    Looks at the middle, then at twice as many places on both sides in each step.
    """
    last = hi - 2  # the end of the last token is the interval's own
    middle = (lo + last) >> 1
    at_a, at_b = np.full(len(lo), -1), np.full(len(lo), -1)
    todo, near, far = np.arange(len(lo)), 0, 1
    while len(todo):
        step = np.arange(near, far)
        places = middle[todo, None] + (step if near == 0 else np.stack([-step, step], 1).ravel())
        inside = (places >= lo[todo, None]) & (places <= last[todo, None])
        ends = a_ends[places[inside]]
        found = np.searchsorted(b_ends, ends)
        hits = np.zeros(places.shape, bool)
        hits[inside] = b_ends[found] == ends
        first = hits.argmax(1)
        hit = hits[np.arange(len(todo)), first]
        at_a[todo[hit]] = places[np.flatnonzero(hit), first[hit]]
        at_b[todo[hit]] = np.searchsorted(b_ends, a_ends[at_a[todo[hit]]])
        todo = todo[~hit]
        near, far = far, 2 * far + 1
        todo = todo[(middle[todo] - near >= lo[todo]) | (middle[todo] + near <= last[todo])]
    return at_a, at_b


class Aligned:
    """Groups of a slice of texts: ids of both sides and the group and text of each."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_edges: np.ndarray, b_edges: np.ndarray, a_length: np.ndarray, b_length: np.ndarray):
        """Of ids, edges of texts among them and byte lengths of the ids' tokens."""
        self.a, self.b, self.texts = a, b, len(a_edges) - 1
        # a slice's bytes fit 32 bits, as no text of Spark's is longer
        self.cut_a, self.cut_b = common_ends(np.cumsum(a_length[a], dtype=np.int32), np.cumsum(b_length[b], dtype=np.int32), a_edges, b_edges)
        self.text_of_group = np.searchsorted(a_edges, self.cut_a, side="right") - 1
        self.first_a, self.first_b = np.r_[0, self.cut_a[:-1] + 1], np.r_[0, self.cut_b[:-1] + 1]
        self.n_groups = np.bincount(self.text_of_group, minlength=self.texts)
        self.in_a, self.in_b = self.cut_a - self.first_a + 1, self.cut_b - self.first_b + 1

    def strings(self, table: pa.Array, n_a: int) -> pa.Array:
        """One string for each text: decimal ids with their signs, sides by | and groups by ;"""
        size = self.in_a + self.in_b
        start = np.cumsum(size) - size
        codes = np.empty(int(size.sum()), np.int64)
        codes[np.arange(len(self.a)) + np.repeat(start - self.first_a, self.in_a)] = 2 * self.a
        codes[np.arange(len(self.b)) + np.repeat(start + self.in_a - self.first_b, self.in_b)] = 2 * (n_a + self.b)
        codes[start + self.in_a - 1] += 1
        ends = start + size - 1
        codes[ends] += 1
        edges = np.cumsum(np.r_[0, np.bincount(self.text_of_group, size, self.texts)]).astype(np.int64)
        some = np.flatnonzero(edges[1:] > edges[:-1])
        flat = table.take(pa.array(codes))
        offsets = np.frombuffer(flat.buffers()[1], "<i8", count=len(flat) + 1)
        data = np.frombuffer(flat.buffers()[2], np.uint8, count=int(offsets[-1])) if len(flat) else np.empty(0, np.uint8)
        keep = np.ones(len(data), bool)
        keep[offsets[edges[some + 1]] - 1] = False  # no sign behind a text's last group
        gone = np.cumsum(np.r_[0, edges[1:] > edges[:-1]])
        return pa.LargeStringArray.from_buffers(self.texts, pa.py_buffer((offsets[edges] - gone).astype("<i8").tobytes()), pa.py_buffer(data[keep].tobytes())).cast(pa.string())

    def pairs(self, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (text, pair, times), rising by text and pair; an A id of a text is in one block."""
        group_a, in_a = np.unique(np.repeat(np.arange(len(self.cut_a)), self.in_a) << ID_BITS | self.a, return_counts=True)
        group_b, in_b = np.unique(np.repeat(np.arange(len(self.cut_b)), self.in_b) << ID_BITS | self.b, return_counts=True)
        low = (1 << ID_BITS) - 1
        group, a = group_a >> ID_BITS, group_a & low
        b_first = np.searchsorted(group_b >> ID_BITS, np.arange(len(self.cut_a) + 1))
        order = np.argsort(self.text_of_group[group] << ID_BITS | a, kind="stable")
        group, a, in_a = group[order], a[order], in_a[order]
        owner = self.text_of_group[group] << ID_BITS | a
        partners = b_first[group + 1] - b_first[group]
        done = np.cumsum(partners)
        start = 0
        while start < len(owner):
            end = int(np.searchsorted(done, (done[start - 1] if start else 0) + block, side="right"))
            end = int(np.searchsorted(owner, owner[max(end, start + 1) - 1], side="right")) if end < len(owner) else end
            s = slice(start, end)
            n = partners[s]
            at = np.repeat(b_first[group[s]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            key = np.repeat(owner[s], n) << ID_BITS | group_b[at] & low
            times = np.repeat(in_a[s], n) * in_b[at]
            by = np.argsort(key, kind="stable")
            key = key[by]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            yield key[first] >> 2 * ID_BITS, key[first] & ((1 << 2 * ID_BITS) - 1), np.add.reduceat(times[by], first)
            start = end


def _slices(texts: pa.Array, most: int) -> Iterator[slice]:
    """Slices of about so many bytes of text."""
    size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), np.int64))
    start = 0
    while start < len(size):
        end = int(np.searchsorted(size, (size[start - 1] if start else 0) + most, side="right"))
        yield slice(start, max(end, start + 1))
        start = max(end, start + 1)


def align(df: DataFrame, a_path: str, b_path: str, text_col: str = "text", pattern: str = public_tokenizers.PATTERN, block: int = BLOCK) -> DataFrame:
    """(row, place, part, parts, n_a, n_b, n_groups, groups, pairs, times) of the groups of every text.

    A path ends in .json (byte-level, tokenizers) or .model (sentencepiece, for
    side B). groups reads a1,a2|b1;a3|b2,b3. pairs are the distinct pairs as
    A id * 2**21 + B id, times how often each is linked; only the first part
    has the groups. place numbers the texts, those of one place are parts of one text.
    """
    contents = []
    for path in (a_path, b_path):
        with open(path, "rb") as file:  # the size of a vocabulary, whatever the data
            contents.append(df.sparkSession.sparkContext.broadcast(file.read()))
    others = [c for c in df.columns if c != text_col]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(None).cast("int").alias("none"))
    read = df.select(row.alias("row"), text_of(text_col).alias("text"))
    longs = ("n_a", "n_b", "n_groups")
    schema = T.StructType([read.schema["row"], T.StructField("place", T.LongType()), T.StructField("part", T.LongType()), T.StructField("parts", T.LongType()), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("groups", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = words_by(a_path, contents[0].value, b_path, contents[1].value, pattern)
        a_side, b_side = cache.sides
        table = pa.array([f"{i}{sign}" for side, signs in ((a_side, ",|"), (b_side, ",;")) for i in range(side.size) for sign in signs], pa.large_string())
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in _slices(batch.column("text"), SLICE):
                n = part.stop - part.start
                words = [words_of(t) for t in batch.column("text").slice(part.start, n).to_pylist()]
                (a, n_a), (b, n_b) = cache.look_up(words)
                sound = np.ones(n, bool)
                for ids, size in ((a, n_a), (b, n_b)):
                    sound[np.repeat(np.arange(n), size)[ids == BAD]] = False
                a, b = a[np.repeat(sound, n_a)], b[np.repeat(sound, n_b)]
                n_a, n_b = n_a * sound, n_b * sound
                found = Aligned(a, b, np.cumsum(np.r_[0, n_a]), np.cumsum(np.r_[0, n_b]), a_side.length, b_side.length)
                yield from _batches(batch.column("row").slice(part.start, n), n_a, n_b, found, found.strings(table, a_side.size), block, place, schema.names)
                place += n

    return read.mapInArrow(run, schema)


def _batches(rows: pa.Array, n_a: np.ndarray, n_b: np.ndarray, found: Aligned, groups: pa.Array, block: int, place: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A row for each text and block of pairs; texts without pairs are in the first batch."""
    blocks = list(found.pairs(block)) if len(n_a) else []
    if not blocks:
        blocks = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
    parts = np.zeros(found.texts, np.int64)
    for text, _, _ in blocks:
        parts[np.unique(text)] += 1
    nth = np.zeros(found.texts, np.int64)
    for k, (text, pair, times) in enumerate(blocks):
        own = np.bincount(text, minlength=found.texts)
        here = np.flatnonzero((own > 0) | ((parts == 0) & (k == 0)))
        take = pa.array(here)
        offsets = pa.array(np.r_[0, np.cumsum(own[here])], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (pair, times.astype(np.int32))]
        texts = pa.compute.if_else(pa.array(nth[here] == 0), groups.take(take), None)
        columns = [rows.take(take), pa.array(place + here), pa.array(nth[here]), pa.array(np.maximum(parts[here], 1)), pa.array(n_a[here]), pa.array(n_b[here]), pa.array(found.n_groups[here]), texts, *lists]
        yield pa.RecordBatch.from_arrays(columns, names=names)
        nth[here] += 1


def count_pairs(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many documents hold a pair of ids linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, n = np.unique(np.asarray(batch.column(0).flatten()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    return aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _shard_of(pair: Column, n_shards: int) -> Column:
    return F.pmod(F.shiftright(pair, ID_BITS), F.lit(n_shards)).cast("int")


def index_pairs(counts: DataFrame, shard_pairs: int = SHARD_PAIRS, folder: str | None = None) -> tuple[str, int]:
    """The shared folder of (pair, n) as sorted arrays, with the highest count of each A id, and the number of shards."""
    spark = counts.sparkSession
    rows = written(counts, "pair-counts")
    n_shards = max(1, -(-rows.count() // shard_pairs))
    uri = shards.new_folder(spark, "pair-index", folder)

    def store(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        pair, n = (np.asarray(table.column(c), np.int64) for c in ("pair", "n"))
        pair, n = pair[pair >= 0], n[pair >= 0]
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
        first = np.flatnonzero(np.r_[True, np.diff(pair >> ID_BITS) != 0]) if len(pair) else np.empty(0, np.int64)
        highest = np.repeat(np.maximum.reduceat(n, first), np.diff(np.r_[first, len(pair)])) if len(pair) else n
        shards.save(uri, f"pairs-{shard}", pair, n, n == highest)
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(pair)], pa.int64())})

    every = spark.range(n_shards).select(F.col("id").cast("int").alias("shard"), F.lit(-1).cast("long").alias("pair"), F.lit(0).cast("long").alias("n"))
    dealt = rows.select(_shard_of(F.col("pair"), n_shards).alias("shard"), "pair", "n").unionByName(every)
    dealt.repartitionById(n_shards, F.col("shard")).groupBy("shard").applyInArrow(store, "shard int, n long").agg(F.sum("n")).collect()
    discard(rows)
    return uri, n_shards


def look_up(uri: str, n_shards: int, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The count of each pair and whether it is its A id's highest; every pair must be in the index."""
    n, best = np.empty(len(pair), np.int64), np.empty(len(pair), bool)
    shard = (pair >> ID_BITS) % n_shards
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0, True]) if len(order) else [0]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        rows = order[low:high]
        stored, counts, highest = shards.load(uri, f"pairs-{shard[rows[0]]}", 3)
        at = np.searchsorted(stored, pair[rows])
        n[rows], best[rows] = counts[at], highest[at]
    return n, best


def link_counts(aligned: DataFrame, shard_pairs: int = SHARD_PAIRS) -> DataFrame:
    """aligned, a row for each text, without pairs, times and place, with n_links, n_best (links whose pair's count is its A id's highest) and count_sum.

    Writes aligned, so leave out before what isn't needed. Its other columns come
    from a text's first part.
    """
    rows = written(aligned, "aligned-texts", codec="zstd")
    uri, n_shards = index_pairs(count_pairs(rows), shard_pairs)
    others = [f for f in rows.schema.fields if f.name not in ("pairs", "times")]
    new = ("n_links", "n_best", "count_sum")
    schema = T.StructType([*others, *(T.StructField(c, T.LongType()) for c in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(pa.compute.list_value_length(batch.column("pairs")), np.int64)
            pair, times = np.asarray(batch.column("pairs").flatten()), np.asarray(batch.column("times").flatten(), np.int64)
            n, best = look_up(uri, n_shards, pair)
            edges = np.cumsum(np.r_[0, size])
            sums = [np.diff(np.r_[0, np.cumsum(v)][edges]) for v in (times, times * best, times * n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), *(pa.array(v, pa.int64()) for v in sums)], names=schema.names)

    found = rows.select(*[f.name for f in others], "pairs", "times").mapInArrow(run, schema)
    kept = [f.name for f in others if f.name not in ("place", "part", "parts")]
    whole = found.where("parts = 1").select(*kept, *new)
    head = F.min_by(F.struct(*kept), "part").alias("head")
    cut = found.where("parts > 1").groupBy("place").agg(head, *(F.sum(c).alias(c) for c in new))
    return whole.unionByName(cut.select(*(F.col("head").getField(c).alias(c) for c in kept), *new))

