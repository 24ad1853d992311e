"""Alignment of two tokenizations, held against the libraries and a set intersection."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from rankweave.llm import alignment
from rankweave.llm.queries import QUERIES
from rankweave.llm.token_count import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """(a ids, b ids, groups) of a text by the libraries and a set of common ends."""
    a_tok, b_tok = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    byte = {c: i for i, c in enumerate(byte_letters())}

    def run(text):
        if not text:
            return [], [], []
        a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
        a_bytes = [bytes(byte[c] for c in a_tok.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            return [], [], []
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted({*a_ends} & {*b_ends}):
            i2, j2 = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
            groups.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        return a, b, groups

    return run


def expected(texts, plain):
    """Rows of the query in the order of the texts."""
    found = [plain(t) for t in texts]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for *_, groups in found]
    count = Counter(pair for link in links for pair in link)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for (a, b, groups), link in zip(found, links, strict=True):
        joined = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n_best = sum(n for p, n in link.items() if count[p] == best[p[0]])
        yield (len(a), len(b), len(groups), link.total(), n_best, sum(n * count[p] for p, n in link.items()), hashlib.sha256(joined.encode()).hexdigest() if joined else "")


ODD = [
    None, "", " ", "   ", "a", " a  b ", "x" * 5000, " " * 3000, "\n\n a\tb \r\n", "▁", "a▁b", "a ▁ b", "<|endoftext|> <s> </s> <unk> <0x41>", "naïve café — “x”", "汉字 漢字かな交じり", "😀😀 👩‍👩‍👧", "a\x1c b\x85 c  d　e f​ g",
    "é ́ x", "\x00 a\x00 b", "don't we'll 12345 67.89 !!! ???", "ไทย ภาษา", "   x", "a­ b", "ᚠᛇᚻ ᛒᛦᚦ", "1 2  3   4    5", "﻿x", "end ", "\U000e0001 x",
]
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def query(spark, texts, folder, **extra):
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    found = QUERIES["op11_token_alignment"](spark, str(folder)).collect()
    assert len(found) == len(texts)
    return [tuple(r[c] for c in COLUMNS) for r in sorted(found, key=lambda r: r["doc_id"])]


def test_odd_texts(spark, tmp_path, plain):
    rng = random.Random(3)
    mixed = ["".join(rng.choice([" ", " ", "\n", *"abcé漢😀▁.1\x1c​　"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts = ODD + mixed + ODD
    assert query(spark, texts, tmp_path) == list(expected(texts, plain))


def test_whole_table(spark, plain):
    """Every text of the small table."""
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_token_alignment"](spark, folder).collect()}
    assert found == dict(zip(docs, expected(docs.values(), plain), strict=True))


def test_small_blocks_and_shards(spark, plain):
    """Texts cut into parts give the same sums; ids may repeat and be null, other columns may have any name."""
    texts = ["one two three " * 30, "汉字 x", None, "one two", "one two", ""]
    rows = [(None if i == 1 else 7, i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, `row` int, text string").withColumnRenamed("doc_id", "n.a")
    aligned = alignment.align(df, A, B, block=5)
    assert aligned.where("parts > 1").count() > 0
    found = alignment.link_counts(aligned.drop("groups"), shard_pairs=3).orderBy("row.row").collect()
    assert [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) for r in found] == [e[:6] for e in expected(texts, plain)]
    assert [r["row"]["n.a"] for r in found] == [7, None, 7, 7, 7, 7]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.link_counts(alignment.align(df, A, B)).count() == 0


def test_common_ends_of_any_shape():
    """Long stretches without a common end, cuts at the edges, and both sides in one."""
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(1, 60)
        share = rng.random()
        texts_a, texts_b, want_a, want_b, base, na, nb = [], [], [], [], 0, 0, 0
        for _ in range(rng.randrange(1, 4)):
            a = sorted({*(x for x in range(1, n) if rng.random() < share), n})
            b = sorted({*(x for x in range(1, n) if rng.random() < 0.3), n})
            both = {*a} & {*b}
            want_a += [na + i for i, x in enumerate(a) if x in both]
            want_b += [nb + i for i, x in enumerate(b) if x in both]
            texts_a.append([base + x for x in a])
            texts_b.append([base + x for x in b])
            base, na, nb = base + n, na + len(a), nb + len(b)
        edges = [np.cumsum([0, *map(len, t)]) for t in (texts_a, texts_b)]
        got = alignment.common_ends(np.array(sum(texts_a, [])), np.array(sum(texts_b, [])), *edges)
        assert got[0].tolist() == want_a and got[1].tolist() == want_b
