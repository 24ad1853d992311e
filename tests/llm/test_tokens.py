"""Byte-level BPE and token counts against the libraries that own the vocabularies."""

import random

import public_tokenizers as files
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankweave.llm import bpe, token_count
from rankweave.llm.pretoken import WordCache, blocks

RANKS, JSON = files.path("byte_bpe_50k.tiktoken"), files.path("byte_bpe_50k.json")
ODD = [" ", "\n\t \n x", "it's we'll 'S", "a" * 1500, "ab" * 700, "é ñ 漢字 \U0001f600", "\x1c\x85 \xa0z", "hi <|endoftext|> you<|endoftext|>", "aaaa aaa aaaaaaa"]


def texts():
    rnd = random.Random(4)
    pick = lambda: chr(rnd.choice([rnd.randrange(0, 0x250), rnd.randrange(32, 127), rnd.randrange(0x3000), 9, 10, 0x1F600]))
    return ODD + ["".join(pick() for _ in range(rnd.randrange(200))) for _ in range(150)]


def test_encode_and_decode_are_exact(spark):
    rows = [(i, t, "own", 7) for i, t in enumerate(texts())] + [(None, None, None, None), (-1, "", "x", 0), (-1, "", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, part int")
    ids = bpe.encode(df, RANKS, files.PATTERN)
    assert ids.columns == ["doc_id", "decoded", "part", "token_ids", "n_tokens"]
    ranks = bpe.Ranks(open(RANKS, "rb").read(), files.PATTERN)
    library = tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})
    back = bpe.decode(ids.withColumn("ids", F.col("token_ids")), RANKS).collect()
    assert len(back) == len(rows)
    by_id = {r["doc_id"]: r for r in back}
    for i, t, *_ in rows:
        expected = library.encode_ordinary(t or "")
        assert bytes(by_id[i]["decoded"]).decode() == (t or "")
        assert by_id[i]["n_tokens"] == len(expected)
        assert [int.from_bytes(by_id[i]["ids"][k : k + 4], "little") for k in range(0, len(by_id[i]["ids"]), 4)] == expected


def test_blocks_give_the_matches_of_the_whole():
    pattern = bpe.Ranks(open(RANKS, "rb").read(), files.PATTERN).pattern
    for t in texts():
        assert [m for b in blocks(t, 13) for m in pattern.findall(b)] == pattern.findall(t)
        assert "".join(blocks(t, 13)) == t


def test_cache_forgets_and_still_answers():
    ranks = bpe.Ranks(open(RANKS, "rb").read(), files.PATTERN)
    small, large = WordCache(ranks.encode_words, limit=3), WordCache(ranks.encode_words)
    for words in (["one", " two", "three"], ["four", "one"], [], [" two", "five", "six"]):
        a, b = small.look_up([words])[0], large.look_up([words])[0]
        assert small.values(a).tolist() == large.values(b).tolist()


def test_counts_are_those_of_the_library(spark):
    library = Tokenizer.from_file(JSON)
    rows = [(i, t, 5) for i, t in enumerate(texts())] + [(None, None, 1), (-1, "", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    found = token_count.count_tokens(df, JSON, files.PATTERN).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    for i, t, _ in rows:
        assert by_id[i]["n_tokens"] == len(library.encode(t or "", add_special_tokens=False).ids), t
        assert by_id[i]["n_bytes"] == len((t or "").encode())


@pytest.mark.parametrize("run", [lambda df: bpe.encode(df, RANKS, files.PATTERN), lambda df: token_count.count_tokens(df, JSON, files.PATTERN)])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_file_that_merges_out_of_order_is_refused():
    import json

    spec = json.load(open(JSON))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    with pytest.raises(ValueError, match="ranks before"):
        token_count.Merges(json.dumps(spec).encode(), files.PATTERN)
