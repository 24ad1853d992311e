"""Text columns: cleaning, optional numbers, tokens, keywords and digit strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width digits, letters and space, and what they stand for.
WIDE = "０１２３４５６７８９ＦＬＳＫ　．－："
NARROW = "0123456789FLSK .-:"


def narrow(x: Column) -> Column:
    """Full-width digits, flags and marks as plain ones."""
    return F.translate(x, WIDE, NARROW)


def collapse(x: Column) -> Column:
    """White space runs to one space, trimmed; empty to null."""
    return F.nullif(F.trim(F.regexp_replace(F.translate(x, "　", " "), r"\s+", " ")), F.lit(""))


def without_spaces(x: Column) -> Column:
    return F.regexp_replace(x, r"[\s　]+", "")


def optional_int(x: Column) -> Column:
    """A whole number, null for blanks and junk."""
    return F.trim(x).try_cast("bigint")


def optional_float(x: Column) -> Column:
    """A number, one leading letter dropped, null for a lone dot."""
    return F.regexp_replace(F.trim(x), "^[A-Za-z]", "").try_cast("double")


def clock_seconds(x: Column) -> Column:
    """m.ss.d as seconds, a plain number as it is."""
    part = F.split(F.trim(x), r"\.")
    parts = [part[k].try_cast("double") for k in range(3)]
    three = parts[0] * 60 + parts[1] + parts[2] / F.pow(F.lit(10.0), F.length(part[2]))
    return F.when(F.size(part) == 3, three).otherwise(F.trim(x).try_cast("double"))


def rank_token(x: Column) -> Column:
    """(rank, status): digits are a rank; anything else is rank 6 and its own status."""
    token = F.trim(x)
    digits = token.rlike("^[0-9]+$")
    return F.struct(F.when(digits, token.try_cast("int")).otherwise(6).alias("rank"), F.when(~digits, token).alias("status"))


def trailing_digit(x: Column) -> Column:
    """(head, digit): a digit at the end split off."""
    return F.struct(F.regexp_extract(x, r"^(.*?)\s*([0-9])?$", 1).alias("head"), F.regexp_extract(x, r"([0-9])$", 1).try_cast("int").alias("digit"))


def tail_fields(x: Column) -> Column:
    """(trial, position, lead, clock) of a row's tail: a number, a single digit, a number, a clock text.

    The position is the first token that is one digit; what stands around it
    says what the others are.
    """
    tokens = F.filter(F.split(F.trim(x), r"\s+"), lambda t: t != "")
    at = F.array_position(F.transform(tokens, lambda t: t.rlike("^[1-6]$")), F.lit(True)).cast("int")
    get = lambda k: F.try_element_at(tokens, k)
    return F.struct(optional_float(F.when(at > 1, get(at - 1))).alias("trial"), F.when(at > 0, get(at)).try_cast("int").alias("position"), optional_float(F.when(at > 0, get(at + 1))).alias("lead"), clock_seconds(F.when(at > 0, get(at + 2))).alias("clock"))


def keyword_class(x: Column, rules: Sequence[tuple[Sequence[str], str]], default: str | None = None) -> Column:
    """The label of the first rule one of whose keywords the text contains."""
    out = F.lit(default)
    for words, name in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | x.contains(w)
        out = F.when(hit, name).otherwise(out)
    return F.when(x.isNotNull(), out)


def ending_class(x: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The label of the first rule whose suffix the text has."""
    out = F.lit(default)
    for suffix, name in reversed(rules):
        out = F.when(x.endswith(suffix), name).otherwise(out)
    return out


def flagged(x: Column) -> Column:
    """Whether a status, in plain letters and upper case, has an F or an L."""
    return F.upper(narrow(x)).rlike("[FL]")


def valid_target(x: Column, status: Column) -> Column:
    """x where it lies in 0..1 and the status has no flag, else null."""
    return F.when(x.between(0, 1) & ~F.coalesce(flagged(status), F.lit(False)), x)


def digits_of(x: Column) -> Column:
    return F.transform(F.filter(F.split(F.regexp_replace(narrow(F.coalesce(x, F.lit(""))), "[^0-9]", ""), ""), lambda d: d != ""), lambda d: d.cast("int"))


def meet_features(x: Column) -> dict[str, Column]:
    """Form of the current meet from a string of results, such as "12 F3"."""
    d = digits_of(x)
    n = F.size(d)
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a))
    last = lambda k: F.slice(d, F.greatest(n - k + 1, F.lit(1)), k)
    count = lambda k: F.size(F.filter(d, lambda v: v == k))
    letters = F.upper(narrow(F.coalesce(x, F.lit(""))))
    return {
        "meet_starts": n, "meet_last": F.when(n > 0, F.element_at(d, -1)), "meet_mean": mean(d), "meet_mean2": mean(last(2)), "meet_mean3": mean(last(3)),
        "meet_best": F.array_min(d), "meet_worst": F.array_max(d), "meet_top3": F.size(F.filter(d, lambda v: v <= 3)), "meet_wins": count(1),
        **{f"meet_{k}": F.regexp_count(letters, F.lit(k.upper())) for k in "fskl"}, **{f"meet_rank{k}": count(k) for k in range(1, 7)},
        "meet_form_gap": mean(d) - mean(last(3)), "meet_top3_share": F.when(n > 0, F.size(F.filter(d, lambda v: v <= 3)) / n),
    }


def percent(x: Column, cap: float | None = None) -> Column:
    shown = x if cap is None else F.least(x, F.lit(cap))
    return F.format_string("%.1f%%", shown * 100)


# Labels of either language and their key.
LABEL_KEYS = {"高": "high", "中": "middle", "低": "low", "high": "high", "middle": "middle", "low": "low"}


def label_key(x: Column) -> Column:
    out = F.lit("low")
    for name, key in LABEL_KEYS.items():
        out = F.when(F.lower(F.trim(x)) == name, key).otherwise(out)
    return out


def parse_overrides(text: str, slots: int = 6) -> dict[int, int]:
    """Position by slot from "213456", "2,1,3,4,5,6" or "1=2,2=1"; every position at most once."""
    text = text.strip()
    if "=" in text:
        found = {int(k): int(v) for k, v in (p.split("=") for p in text.split(","))}
    else:
        values = [int(p) for p in (text.split(",") if "," in text else list(text))]
        if len(values) != slots:
            raise ValueError(f"{slots} positions are needed")
        found = dict(enumerate(values, 1))
    if len(set(found.values())) != len(found) or not all(1 <= p <= slots for p in (*found, *found.values())):
        raise ValueError("positions must be different and inside the contest")
    return found
