"""Toxicity and personal data."""

import math
import random
import re
import time
import zlib

import numpy as np
import pytest

from rankweave.llm import pii, toxicity

PLAIN_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def plain_base(t):
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in PLAIN_IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    for k, pattern, low, high in ((2, pii.CARD, 16, 19), (3, pii.PHONE, 8, 15)):
        for m in pattern.finditer(t):
            digits = re.sub(r"[^0-9]", "", m.group())
            total = sum((x - 9 if x > 9 else x) for i, c in enumerate(digits[::-1]) for x in [int(c) * (1 + i % 2)])
            if low <= len(digits) <= high and (k == 3 or total % 10 == 0):
                out.append((k, *m.span()))
    return out


def test_base_spans_are_those_of_the_patterns():
    rnd = random.Random(3)
    parts = ["@", "a", "b.", "-", "%", "1", "23", "456", ".", "+", " ", "9", "(", ")", "7.7.7.7", "4111111111111111", "é"]
    for _ in range(20_000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randrange(25)))
        assert pii.base_spans(t) == plain_base(t), t


TEXTS = [
    (1, "mail joe.doe@mail.example.com or +1 (555) 555-0100, host 10.0.0.255"), (2, "card 4111 1111 1111 1111 and 4111-1111-1111-1112"), (3, "write to jane [at] example [dot] org"),
    (4, "my ssn is 123-45-6789, IBAN DE89 3704 0044 0532 0130 00"), (5, "Dr. Anna Smith called 555-123-4567"), (6, "version 10.20.30.400 page 1234567 price 12.50"), (7, None), (8, ""), (None, "x" * 30_000),
]


def test_candidates_are_added_and_base_stays(spark):
    df = spark.createDataFrame([(*t, "s") for t in TEXTS * 3], "doc_id long, text string, spans string")
    marked = pii.mark(df, keep_text=True)
    model = pii.fit(marked)
    found = pii.find(marked, model).collect()
    assert [f.name for f in marked.schema] == ["doc_id", "text", "base", "candidates"]
    assert len(found) == 3 * len(TEXTS)
    by_id = {r["doc_id"]: r for r in found}
    for i, t in TEXTS:
        base = [(s["kind"], s["start"], s["end"]) for s in by_id[i]["base_spans"]]
        assert base == [(pii.KINDS[k], a, b) for k, a, b in plain_base(t or "")]
        assert set(base) <= {(s["kind"], s["start"], s["end"]) for s in by_id[i]["spans"]}
    kinds = lambda i: [s["kind"] for s in by_id[i]["spans"]]
    assert kinds(3) == ["email"] and "identity" in kinds(4) and "account" in kinds(4) and "name" in kinds(5) and kinds(6) == []
    clean = {r["doc_id"]: r["text"] for r in pii.redact(marked, model).collect()}
    assert clean[1] == "mail [EMAIL] or [PHONE], host [IP]" and clean[7] is None and clean[8] == ""
    none = pii.mark(df.limit(0))
    assert pii.find(none, pii.fit(none)).collect() == []


def test_em_finds_the_reliable_labeler():
    # labeler 0 is right nine times in ten, labeler 1 six times in ten
    rng = np.random.default_rng(0)
    counts = {}
    for _ in range(20_000):
        truth = rng.random() < 0.5
        votes = [(truth if rng.random() < r else not truth) for r in (0.9, 0.6, 0.8)]
        code = sum((2 if v else 1) * 3**k for k, v in enumerate(votes))
        counts[0, code] = counts.get((0, code), 0) + 1
    right, _ = pii.reliabilities(counts)
    assert right[0].mean() > right[2].mean() > right[1].mean()
    assert right[0].mean() == pytest.approx(0.9, abs=0.03)


LOOSE = {
    "number": re.compile(r"(?<![\w.])\(?[0-9][0-9 ().-]{5,24}[0-9](?![\w])"),
    "titled": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Madame|Monsieur)\.? +([A-Z][\w'-]+(?: [A-Z][\w'-]+)?)"),
    "account": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
}


def plain_candidates(t):
    """Spans of numbers, names and accounts by plain patterns, each held against all that came before."""
    raw = [(k[0], *m.span()) for m in LOOSE["number"].finditer(t) if (k := pii._number_kind(m.group()))]
    raw += [("name", *m.span(1)) for m in LOOSE["titled"].finditer(t)] + [("account", *m.span()) for m in LOOSE["account"].finditer(t)]
    out, taken = [], [(s, e) for _, s, e in pii.base_spans(t)]
    for kind, s, e in sorted(raw, key=lambda r: (r[1], -r[2], r[0])):
        if all(e <= a or b <= s for a, b in taken):
            taken.append((s, e))
            out.append((pii.KINDS.index(kind), s, e))
    return out


def test_candidates_are_those_of_the_plain_patterns():
    rnd = random.Random(4)
    parts = ["Dr. ", "Mr ", "Mrs", "Señora ", "Anna ", "Smith", "xMr ", "555-123-4567", "(030) 123 45", "123-45-6789", " ", ".", "(", "7", "4111 1111 1111 1112", "DE89 3704 0044 0532 0130 00", "10.0.0.1", "+1 555 555 0100", "a@b.c", "\n"]
    seen = 0
    for _ in range(5_000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randrange(20)))
        found = [c[:3] for c in pii.candidates(t, pii.base_spans(t))]
        assert found == plain_candidates(t), t
        seen += len(found)
    assert seen > 5_000


@pytest.mark.parametrize(
    "text",
    ["1" * 5_000 + ".1.1.1", "1" * 1_000_000, "0" * 5_000 + "1.2.3.4", "a" * 1_000_000 + " dot ", "a.b-c" * 200_000 + " at x dot ", "555-123-4567 x " * 100_000, "1.1.1.1 " * 100_000, "Mr " * 300_000, "AB12" * 250_000, "+1" * 400_000, "a@" * 400_000, "@a.b" * 200_000, "( " * 400_000, "1 " * 400_000],
    ids=lambda t: t[:12],
)
def test_long_texts_take_seconds(text):
    start = time.perf_counter()
    found = pii.candidates(text, pii.base_spans(text))
    assert time.perf_counter() - start < 10
    if text.startswith("555"):
        assert len(found) == 100_000
    if text.startswith("0000"):
        assert pii.base_spans(text)[0][:2] == (1, 0)


def test_reliabilities_and_classifier_are_those_of_single_rows():
    rng = np.random.default_rng(1)
    counts = {(int(k), int(c)): int(n) for k, c, n in zip(rng.integers(0, 7, 40), rng.integers(0, 81, 40), rng.integers(1, 30, 40))}
    rows = [key for key, n in sorted(counts.items()) for _ in range(n)]
    right = {(j, y): 0.8 for j in range(4) for y in (0, 1)}
    prior = {k: 0.5 for k in range(7)}
    for _ in range(50):  # expectation-maximisation, a row at a time
        post = []
        for k, code in rows:
            yes, no = prior[k], 1 - prior[k]
            for j in range(4):
                v = code // 3**j % 3
                if v == pii.YES:
                    yes, no = yes * right[j, 1], no * (1 - right[j, 0])
                elif v == pii.NO:
                    yes, no = yes * (1 - right[j, 1]), no * right[j, 0]
            post.append(yes / (yes + no))
        for j in range(4):
            votes = [code // 3**j % 3 for _, code in rows]
            for y, vote in ((1, pii.YES), (0, pii.NO)):
                weight = [p if y else 1 - p for p in post]
                hit = sum(w for w, v in zip(weight, votes) if v == vote)
                right[j, y] = min(max((hit + 8) / (sum(w for w, v in zip(weight, votes) if v) + 10), 0.55), 0.99)
        for k in prior:
            of = [p for p, (kind, _) in zip(post, rows) if kind == k]
            prior[k] = min(max((sum(of) + 5) / (len(of) + 10), 0.02), 0.98)
    found, posterior = pii.reliabilities(counts)
    assert found == pytest.approx(np.array([[right[j, 0], right[j, 1]] for j in range(4)]), abs=1e-9)
    assert all(posterior[key] == pytest.approx(p, abs=1e-6) for key, p in zip(rows, post))

    def one_hot(k, code):
        x = np.zeros(15)
        x[k] = 1
        for j in range(4):
            if v := code // 3**j % 3:
                x[7 + 2 * j + (v == pii.YES)] = 1
        return x

    # a plain descent on the same ridge-penalised loss
    x, y = np.array([one_hot(*k) for k in sorted(counts)]), np.array([posterior[k] for k in sorted(counts)])
    weight, w = np.sqrt([counts[k] for k in sorted(counts)]), np.zeros(15)
    for _ in range(200_000):
        w += 0.02 * (x.T @ (weight * (y - 1 / (1 + np.exp(-x @ w)))) - 0.1 * w)
    rules = pii.classifier(counts, posterior)
    assert all(rules[key] == pytest.approx(1 / (1 + np.exp(-one_hot(*key) @ w)), abs=1e-4) for key in rules)


def toxic_table(n=1200):
    rnd = random.Random(1)
    words, bad = [f"w{i}" for i in range(300)], ["idiot", "scum", "moron"]
    rows, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.25
        text = [rnd.choice(words) for _ in range(40)] + ([rnd.choice(bad) for _ in range(3)] if toxic else [])
        rnd.shuffle(text)
        rows.append((i, " ".join(text), "en"))
        if rnd.random() < 0.6:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = toxic_table()
    df = spark.createDataFrame([*rows, (None, None, "x"), (-5, "", "x")], "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, marks)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    held = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 80
    assert np.mean([(found[i] >= 0.5) == bool(t) for i, t in held]) > 0.95
    assert found[None] == found[-5] < 0.5 and all(0 <= s <= 1 for s in found.values())
    again = toxicity.fit(df.repartition(7), marks)
    assert again.weights == model.weights and again.bias == model.bias


def test_labels_of_fold_0_say_nothing(spark):
    rows, labels = toxic_table(400)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    schema = "doc_id long, quality int, toxic int"
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (toxicity.fit(df, spark.createDataFrame(x, schema)) for x in (labels, turned))
    assert a.weights == b.weights and a.bias == b.bias


def test_without_labels_or_texts(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert toxicity.score(df, toxicity.fit(df, none)).collect()[0]["score"] < 1e-9
    assert toxicity.score(df.limit(0), toxicity.fit(df.limit(0), none)).collect() == []


def test_the_risk_never_goes_below_zero_for_long():
    # few unlabelled texts that are all clean: a plain estimator would run away
    rng = np.random.default_rng(0)
    pos = [np.unique(rng.integers(0, 50, 20)).astype(np.uint32) for _ in range(100)]
    unl = [np.unique(rng.integers(40, 90, 20)).astype(np.uint32) for _ in range(100)]
    model = toxicity.fit_nnpu(pos, unl, 0.4)
    assert np.isfinite(list(model.weights.values())).all() and np.isfinite(model.bias)


def test_the_fit_is_that_of_a_plain_descent():
    """The non-negative risk over dense rows, gradients word by word."""
    rng = np.random.default_rng(3)
    made = lambda bad, plain: np.flatnonzero(rng.random(30) < np.r_[np.full(10, bad), np.full(20, plain)]).astype(np.uint32)
    pos, unl = [made(0.6, 0.2) for _ in range(150)], [made(0.08, 0.3) for _ in range(200)]
    prior, steps = 0.3, 40
    model = toxicity.fit_nnpu(pos, unl, prior, steps=steps)
    rate = lambda rows, w, n: (sum(w in r for r in rows) + 0.5) / (n + 1)
    odds = {}
    for w in range(30):
        n_p, n_u = sum(w in r for r in pos), sum(w in r for r in unl)
        p, u = rate(pos, w, 150), rate(unl, w, 200)
        if n_p + n_u >= 8 and abs(math.log(p / u)) > 4 * math.sqrt(1 / (n_p + 0.5) + 1 / (n_u + 0.5)):
            odds[w] = math.log(p / (max(u - prior * p, 0.5 / 201) / (1 - prior)))
    assert odds and set(odds) == set(model.weights)
    words = sorted(odds)
    w, b = {k: 0.5 for k in words}, math.log(prior / (1 - prior))
    m, v = {k: 0.0 for k in [*words, "b"]}, {k: 0.0 for k in [*words, "b"]}
    squash = lambda x: 1 / (1 + math.exp(-x))
    for step in range(1, steps + 1):
        out = lambda r: sum(w[k] * odds[k] for k in words if k in r) + b
        g_p, g_u = [out(r) for r in pos], [out(r) for r in unl]
        negative = sum(math.log1p(math.exp(x)) for x in g_u) / 200 - prior * sum(math.log1p(math.exp(x)) for x in g_p) / 150
        grad = {}
        for k in [*words, "b"]:
            has = lambda r, k=k: 1.0 if k == "b" else odds[k] * (k in r)
            down = sum(prior * (squash(x) - 1) / 150 * has(r) for x, r in zip(g_p, pos))
            other = sum(squash(x) / 200 * has(r) for x, r in zip(g_u, unl)) - sum(prior * squash(x) / 150 * has(r) for x, r in zip(g_p, pos))
            grad[k] = (down + other if negative >= 0 else -other) + (0 if k == "b" else 1e-3 * w[k])
            m[k], v[k] = 0.9 * m[k] + 0.1 * grad[k], 0.999 * v[k] + 0.001 * grad[k] ** 2
        for k in [*words, "b"]:
            move = 0.05 * (m[k] / (1 - 0.9**step)) / (math.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            if k == "b":
                b -= move
            else:
                w[k] -= move
    assert model.bias == pytest.approx(b, abs=1e-6)
    assert all(model.weights[k] == pytest.approx(w[k] * odds[k], abs=1e-6) for k in words)


def test_repeated_ids_and_long_texts_are_scored_each_for_itself(spark):
    rows, labels = toxic_table(400)
    df = spark.createDataFrame([*rows, *rows[:3], (1, "w1 " * 200_000, "en")], "doc_id long, text string, lang string").withColumnRenamed("lang", "toxic_score")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = toxicity.score(df, model, out="toxic_score").collect()
    assert len(found) == 404 and all(0 <= r["toxic_score"] <= 1 for r in found)
