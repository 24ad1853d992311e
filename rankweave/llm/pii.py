"""Personal data by weak supervision.

Two sorts of spans are found in every whole text. Base spans are exact: e-mail
addresses, IP numbers, payment cards and phone numbers by their patterns and
checks. Candidates are looser: numbers grouped as phones, cards and identity
numbers, addresses spelt with "at" and "dot", account numbers, and names
behind a title or an introduction. On each candidate three kinds of labelers
vote yes, no or nothing: patterns, gazetteers and the words around it.

A text is searched once: `mark` writes down its base spans and candidates with
their votes. The votes of the whole corpus are counted in Spark by vote
pattern, of which there is a fixed number. Expectation-maximisation over the
counts gives every labeler's reliability, with the prior of each kind; a
logistic classifier over the labelers' features, trained on the resulting
posteriors, then decides on each pattern. Base spans stay whatever it says;
candidates that overlap them or an earlier candidate are dropped.

A null text counts as empty, and has no spans. Offsets are code points, the
end exclusive. Search time grows in proportion to a text, however long its
runs of digits, letters or candidates are. Of candidates that start at one
place the longest counts, then the kind first by name. Repeated rows and ids
are rows like others. An empty table gives an empty result, and a model that
knows nothing. Columns of df pass through; those named like a new one
(`base`, `candidates`, `base_spans`, `spans`) are replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.scratch import free_name

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "identity", "name")
ABSTAIN, NO, YES = 0, 1, 2

# The base patterns. A run of digits is tried from its start only, where the leftmost match would begin.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9](?<![0-9].)[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", re.S)
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

DIGIT = re.compile(r"[0-9]")
NUMBER = re.compile(r"[0-9(](?<![\w.][0-9(])(?:(?<=\()[0-9]|(?<!\())[0-9 ().-]{5,24}[0-9](?!\w)")
SPELT = re.compile(r"(?<![\w.+-])[\w.+-]++ ?(?:\[at\]|\(at\)| at ) ?[\w-]++(?: ?(?:\[dot\]|\(dot\)| dot ) ?[\w-]++)+", re.I)
ACCOUNT = re.compile(r"[A-Z](?<!\w[A-Z])[A-Z][0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
NAME = r" +([A-Z][\w'-]+(?: [A-Z][\w'-]+)?)"
# Gazetteers of titles, introductions, given names and words beside numbers.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Madame", "Monsieur")
INTRODUCTIONS = ("y name is", "ch heiße", "e m'appelle", "e llamo")
INTRODUCED = re.compile(r"\b(?:[Mm]y name is|[Ii]ch heiße|[Jj]e m'appelle|[Mm]e llamo)" + NAME)
GIVEN = frozenset("james mary john patricia robert jennifer michael linda david elizabeth william susan thomas anna peter maria hans petra klaus sabine jean marie pierre sophie jose carmen juan ana luis laura".split())
NEAR = {
    "phone": frozenset("phone tel telephone call mobile cell fax telefon anrufen téléphone teléfono móvil".split()),
    "card": frozenset("card visa mastercard amex credit debit payment karte carte tarjeta".split()),
    "identity": frozenset("ssn social security passport identity id tax ausweis passeport pasaporte dni".split()),
    "account": frozenset("iban account bank konto compte cuenta".split()),
    "email": frozenset("mail email e-mail contact write correo courriel".split()),
    "name": frozenset("name signed sincerely regards dear".split()),
}
AGAINST = frozenset("version isbn page pages figure table chapter year section equation price total".split())
TOKEN = re.compile(r"[\w'-]+")
# a class of first letters makes the scan for titles three times as fast as alternatives do
TITLED = re.compile(r"[{}](?<!\w.)(?:{})\.?".format("".join(sorted({t[0] for t in TITLES})), "|".join(f"(?<={t[0]}){t[1:]}" for t in TITLES)) + NAME)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the exact kinds, by kind and start."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not DIGIT.search(text):
        return found
    if "." in text:
        found += [(1, *m.span()) for m in IP.finditer(text) if all(_byte(p) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return found


def _byte(digits: str) -> bool:
    """At most 255; leading zeros may be many."""
    short = digits.lstrip("0")
    return len(short) < 3 or len(short) == 3 and short <= "255"


def _covered(base: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that base spans cover, rising."""
    starts: list[int] = []
    ends: list[int] = []
    for _, s, e in sorted(base, key=lambda x: x[1]):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _context(text: str, start: int, end: int, kind: str) -> int:
    words = {w.lower() for w in TOKEN.findall(text[max(0, start - 40) : start])[-5:]} | {w.lower() for w in TOKEN.findall(text[end : end + 20])[:2]}
    if words & NEAR[kind]:
        return YES
    return NO if words & AGAINST else ABSTAIN


def _number_kind(raw: str) -> tuple[str, int, int] | None:
    """Kind of a loose number with the votes of the pattern and the check labeler."""
    digits = _digits(raw)
    if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", raw):
        return "identity", YES, NO if digits[:3] in ("000", "666") or digits[0] == "9" else YES
    if 13 <= len(digits) <= 19 and re.fullmatch(r"[0-9]+(?:[ -][0-9]+)*", raw):
        grouped = re.fullmatch(r"[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -]?[0-9]{1,3})?", raw) or re.fullmatch(r"3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}", raw)
        return "card", YES if grouped else ABSTAIN, YES if luhn(digits) else NO
    if 8 <= len(digits) <= 15 and not re.fullmatch(r"[0-9]+", raw):
        shaped = re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", raw) or re.fullmatch(r"0[0-9]{1,4}[ /-][0-9 ]{5,10}", raw)
        dotted = raw.count(".") >= 3 or re.search(r"\.{2}|--| {2}", raw)
        return "phone", YES if shaped else NO if dotted else ABSTAIN, ABSTAIN
    return None


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, votes) of loose spans that don't overlap base spans; votes are base 3: pattern, check, gazetteer, context."""
    raw: list[tuple[str, int, int, int, int, int]] = []
    digits = DIGIT.search(text)
    if digits:
        for m in NUMBER.finditer(text):
            if kind := _number_kind(m.group()):
                raw.append((kind[0], m.start(), m.end(), kind[1], kind[2], ABSTAIN))
    low = text.lower() if "dot" in text or "DOT" in text or "Dot" in text else ""
    if " dot " in low or "(dot)" in low or "[dot]" in low:
        for m in SPELT.finditer(text):
            bracket = "[" in m.group() or "(" in m.group()
            last = m.group().rsplit(None, 1)[-1].rsplit(")", 1)[-1].rsplit("]", 1)[-1].lower()
            raw.append(("email", *m.span(), YES if bracket else ABSTAIN, ABSTAIN, YES if last in ("com", "org", "net", "edu", "de", "fr", "es") else NO))
    for m in ACCOUNT.finditer(text) if digits else ():
        compact = m.group().replace(" ", "")
        moved = int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4]))
        raw.append(("account", *m.span(), YES, YES if moved % 97 == 1 else NO, ABSTAIN))
    for pattern in (TITLED, INTRODUCED) if any(i in text for i in INTRODUCTIONS) else (TITLED,):
        for m in pattern.finditer(text):
            given = m.group(1).split()[0].lower() in GIVEN
            raw.append(("name", *m.span(1), YES, ABSTAIN, YES if given else ABSTAIN))
    if not raw:
        return []
    starts, ends = _covered(base)
    out, last = [], 0
    for name, start, end, pattern, check, gazetteer in sorted(raw, key=lambda r: (r[1], -r[2], r[0])):
        at = bisect_right(starts, end - 1) - 1  # the last covered stretch that starts before the end
        if start < last or at >= 0 and ends[at] > start:
            continue
        votes = pattern + 3 * check + 9 * gazetteer + 27 * _context(text, start, end, name)
        out.append((KINDS.index(name), start, end, votes))
        last = end
    return out


LABELERS = 4


def _votes(code: int) -> list[int]:
    return [code // 3**k % 3 for k in range(LABELERS)]


def reliabilities(counts: dict[tuple[int, int], int], rounds: int = 50) -> tuple[np.ndarray, dict[tuple[int, int], float]]:
    """EM over vote patterns: for each labeler P(vote | truth), and the posterior of each (kind, votes).

    Starts from labelers that are right in four of five votes; a labeler's
    silence says nothing. A smoothing count keeps unseen votes possible.
    """
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    votes = np.array([_votes(code) for _, code in keys]).reshape(len(keys), LABELERS)
    kind = np.array([k for k, _ in keys], int)
    right = np.full((LABELERS, 2), 0.8)  # P(no | false), P(yes | true) among those who vote
    prior = np.full(len(KINDS), 0.5)
    post = np.full(len(keys), 0.5)
    for _ in range(rounds):
        log = np.log(prior[kind]) - np.log1p(-prior[kind])
        for j in range(LABELERS):
            yes, no = votes[:, j] == YES, votes[:, j] == NO
            log = log + yes * (math.log(right[j, 1]) - math.log(1 - right[j, 0])) + no * (math.log(1 - right[j, 1]) - math.log(right[j, 0]))
        post = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        for j in range(LABELERS):
            yes, no = votes[:, j] == YES, votes[:, j] == NO
            right[j, 1] = ((n * post)[yes].sum() + 8) / ((n * post)[yes | no].sum() + 10)
            right[j, 0] = ((n * (1 - post))[no].sum() + 8) / ((n * (1 - post))[yes | no].sum() + 10)
        right = np.clip(right, 0.55, 0.99)  # a labeler is better than chance
        for k in range(len(KINDS)):
            of = kind == k
            prior[k] = np.clip(((n * post)[of].sum() + 5) / (n[of].sum() + 10), 0.02, 0.98)
    return right, dict(zip(keys, post.tolist(), strict=True))


def classifier(counts: dict[tuple[int, int], int], posterior: dict[tuple[int, int], float], steps: int = 300) -> dict[tuple[int, int], float]:
    """A logistic span classifier on kind and votes, trained on the posteriors; its probability for every possible pattern."""

    def features(kind: int, code: int) -> np.ndarray:
        x = np.zeros(len(KINDS) + 2 * LABELERS)
        x[kind] = 1
        for j, v in enumerate(_votes(code)):
            if v:
                x[len(KINDS) + 2 * j + (v == YES)] = 1
        return x

    everything = [(k, c) for k in range(len(KINDS)) for c in range(3**LABELERS)]
    design = np.array([features(*key) for key in everything])
    w = np.zeros(design.shape[1])
    if counts:
        seen = np.array([everything.index(k) for k in sorted(counts)])
        x, y = design[seen], np.array([posterior[k] for k in sorted(counts)])
        weight = np.array([math.sqrt(counts[k]) for k in sorted(counts)])
        for _ in range(steps):  # Newton steps with a ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + 0.1 * np.eye(len(w))
            step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 0.1 * w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
    p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
    return dict(zip(everything, p.tolist(), strict=True))


SPAN = T.StructType([T.StructField(c, T.IntegerType()) for c in ("kind", "start", "end")])
CANDIDATE = T.StructType([*SPAN.fields, T.StructField("votes", T.IntegerType())])
Rules = dict[tuple[int, int], float]


def mark(df: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """df with `base` and `candidates`, spans with the kind as its place in KINDS; without the text unless keep_text.

    This is the only search of the texts: write the result and give it to
    `fit` and to `find` or `redact`.
    """
    new = ("base", "candidates", "base_spans", "spans")
    others = [f for f in df.schema.fields if f.name not in new and (keep_text or f.name != text_col)]
    schema = T.StructType([*others, T.StructField("base", T.ArrayType(SPAN)), T.StructField("candidates", T.ArrayType(CANDIDATE))])
    base_type, more_type = (pa.list_(pa.struct([(f.name, pa.int32()) for f in t.fields])) for t in (SPAN, CANDIDATE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda spans, t: [dict(zip(t.names, s, strict=True)) for s in spans]
        for batch in batches:
            base, more = [], []
            for text in batch.column(at).to_pylist():
                exact = base_spans(text) if text else []
                base.append(named(exact, SPAN))
                more.append(named(candidates(text, exact), CANDIDATE) if text else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(base, base_type), pa.array(more, more_type)], names=schema.names)

    at = [f.name for f in others].index(text_col) if keep_text else len(others)
    text = [] if keep_text else [df[f"`{text_col}`"].alias(free_name(df, "__text"))]
    return df.select(*[df[f"`{f.name}`"] for f in others], *text).mapInArrow(run, schema)


def fit(marked: DataFrame) -> Rules:
    """Probability of every (kind, votes) pattern, learnt from the candidates of all texts; a table of fixed size."""
    seen = marked.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes").agg(F.count("*").alias("n")).collect()
    counts = {(r["kind"], r["votes"]): r["n"] for r in seen}
    _, posterior = reliabilities(counts)
    return classifier(counts, posterior)


def _all_spans(rules: Rules) -> Column:
    """Base spans and accepted candidates, by kind and start."""
    accepted = F.lit([rules[k, c] >= 0.5 for k in range(len(KINDS)) for c in range(3**LABELERS)])
    good = F.filter("candidates", lambda c: F.element_at(accepted, c["kind"] * 3**LABELERS + c["votes"] + 1))
    return F.sort_array(F.concat("base", F.transform(good, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))))


def find(marked: DataFrame, rules: Rules) -> DataFrame:
    """marked with `base_spans` and `spans`, arrays of (kind, start, end), in place of `base` and `candidates`."""
    names = F.lit(list(KINDS))
    named = lambda spans: F.transform(spans, lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    others = [F.col(f"`{c}`") for c in marked.columns if c not in ("base", "candidates")]
    return marked.select(*others, named(F.sort_array("base")).alias("base_spans"), named(_all_spans(rules)).alias("spans"))


def redact(marked: DataFrame, rules: Rules, text_col: str = "text") -> DataFrame:
    """marked, with its text, where [KIND] is written over each span; without `base` and `candidates`."""
    others = [f for f in marked.schema.fields if f.name not in ("base", "candidates")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            spans = batch.column(batch.num_columns - 1).to_pylist()
            columns = list(batch.columns[:-1])
            columns[at] = pa.array([t and redacted(t, [(s["kind"], s["start"], s["end"]) for s in found]) for t, found in zip(columns[at].to_pylist(), spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return marked.select(*[marked[f"`{f.name}`"] for f in others], _all_spans(rules).alias(free_name(marked, "__spans"))).mapInArrow(run, T.StructType(others))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with [KIND] for each span; of spans that overlap the first one names the kind of the whole."""
    out, done = [], 0
    merged: list[list[int]] = []
    for k, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([k, s, e])
    for k, s, e in merged:
        out += [text[done:s], f"[{KINDS[k].upper()}]"]
        done = e
    return "".join([*out, text[done:]])
