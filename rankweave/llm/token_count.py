"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch lie one behind the other in one flat array
of symbols. In every round each sequence finds its lowest merge rank, all
places of that rank in the sequence merge at once (from the left where they
overlap), and the absorbed symbols leave the array. Sequences without a merge
left leave the round; what they hold is their count.

Merging all places of the lowest rank at once gives what merging them one by
one gives if each merge ranks behind the merges that make its two parts; the
vocabulary is checked for that when it is read.

A null text has no bytes and no tokens. Repeated rows are counted each for
itself, an empty table gives an empty result, and columns named like the new
ones are replaced. Strings of added tokens inside a text
count as one token each, as the tokenizer file has them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rankweave.llm.bpe import NONE, PairTable, _slices
from rankweave.llm.pretoken import WordCache, blocks
from rankweave.llm.scratch import free_name


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + moved.index(b)) for b in range(256)]


class Merges:
    """A tokenizer file of the byte-level kind: symbols, merges in order of rank, added tokens."""

    def __init__(self, content: bytes, pattern: str):
        spec = json.loads(content)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain = not spec["normalizer"] and not spec["post_processor"] and before["type"] == "ByteLevel" and not before["add_prefix_space"] and before["use_regex"]
        if model["type"] != "BPE" or model["dropout"] or model["ignore_merges"] or model["byte_fallback"] or not plain:
            raise ValueError("only plain byte-level BPE files can be counted")
        added = spec["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("added tokens must match as they are")
        self.pattern = regex.compile(pattern)
        self.added = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int32)
        right = np.array([vocab[b] for _, b in merges], np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        born = np.full(max(vocab.values()) + 1, -1, np.int64)
        born[self.made[::-1]] = np.arange(len(merges))[::-1]
        if (born[left] >= np.arange(len(merges))).any() or (born[right] >= np.arange(len(merges))).any() or len(np.unique(self.made)) < len(merges):
            raise ValueError("a merge ranks before the merges that make its parts")
        self.pairs = PairTable(left, right, np.arange(len(merges), dtype=np.int32))
        self.byte = np.array([vocab[c] for c in byte_letters()], np.int32)

    def count_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """One value for each word: the symbols that survive all merges."""
        counts = np.zeros(len(words), np.int32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols, owner = self.byte[np.frombuffer(b"".join(words), np.uint8)], np.repeat(np.arange(len(words)), sizes)
        ranks = self._ranks(symbols, owner)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            length = np.diff(np.r_[first, len(owner)])
            lowest = np.minimum.reduceat(ranks, first)
            over = lowest == NONE
            counts[owner[first[over]]] = length[over]
            lowest = np.repeat(np.where(over, np.int32(-1), lowest), length)
            hit = ranks == lowest
            at = np.flatnonzero(hit)
            if len(at):
                # of places in a row only every second one can merge
                run = np.flatnonzero(np.r_[True, np.diff(at) > 1])
                nth = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
                at = at[nth % 2 == 0]
                symbols[at] = self.made[ranks[at]]
            keep = lowest >= 0
            keep[at + 1] = False
            touched = np.zeros(len(symbols), bool)
            touched[at] = True
            touched[np.maximum(at - 1, 0)] = True
            # the symbol before a merged pair may itself have been absorbed
            two_back = at[(at >= 2)]
            touched[two_back - 2] = True
            symbols, owner, ranks, touched = symbols[keep], owner[keep], ranks[keep], touched[keep]
            again = np.flatnonzero(touched)
            if len(again) and len(symbols):
                after = np.minimum(again + 1, len(symbols) - 1)
                fresh = self.pairs.get(symbols[again], symbols[after])
                fresh[(owner[again] != owner[after]) | (again == after)] = NONE
                ranks[again] = fresh
        return counts, np.ones(len(words), np.int64)

    def _ranks(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The rank of every symbol with the next one of its sequence."""
        ranks = np.full(len(symbols), NONE, np.int32)
        if len(symbols) > 1:
            ranks[:-1] = np.where(owner[1:] == owner[:-1], self.pairs.get(symbols[:-1], symbols[1:]), NONE)
        return ranks

    def parts(self, text: str) -> tuple[list[str], int]:
        """The text between added tokens, and how many of those it has."""
        if self.added is None or not self.added.search(text):
            return [text], 0
        between = self.added.split(text)
        return between, len(between) - 1


@lru_cache(maxsize=2)
def merges_of(content: bytes, pattern: str) -> Merges:
    return Merges(content, pattern)


def count_tokens(df: DataFrame, tokenizer_path: str, pattern: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """df without its text, with n_bytes (UTF-8) and the number of tokens in `out`."""
    with open(tokenizer_path, "rb") as file:  # the size of a vocabulary, whatever the data
        content = df.sparkSession.sparkContext.broadcast(file.read())
    others = [f for f in df.schema.fields if f.name not in (text_col, out, "n_bytes")]
    schema = T.StructType([*others, T.StructField("n_bytes", T.LongType()), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = merges_of(content.value, pattern)
        cache = WordCache(vocabulary.count_words)
        match = vocabulary.pattern.findall
        for batch in batches:
            at = batch.num_columns - 1
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                texts = [t or "" for t in part.column(at).to_pylist()]
                counts = []
                for a, b in _slices(texts):
                    split = [vocabulary.parts(t) for t in texts[a:b]]
                    cut = [[x for p in between for x in blocks(p)] for between, _ in split]
                    found = iter(cache.look_up([match(x) for c in cut for x in c]))
                    counts += [special + sum(int(cache.values(next(found)).sum()) for _ in c) for c, (_, special) in zip(cut, split, strict=True)]
                columns = [part.column(i) for i in range(part.num_columns) if i != at]
                n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64())], names=schema.names)

    return df.select(*[df[f"`{f.name}`"] for f in others], df[f"`{text_col}`"].alias(free_name(df, "__text"))).mapInArrow(run, schema)
