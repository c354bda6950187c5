"""Scalar column expressions. All stay inside code generation; no Python UDFs."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- recoding ---------------------------------------------------------------

def recode(c: Column | str, values: Mapping, default=None, lower: bool = False) -> Column:
    """Text to number by a scale; `default` also replaces values mapped to None."""
    c = as_col(c)
    key = F.lower(c) if lower else c
    out = None
    by_number: dict = {}
    for text, number in values.items():
        if number is not None:
            by_number.setdefault(float(number), []).append(text)
    for number, texts in by_number.items():
        out = F.when(key.isin(*texts), F.lit(number)) if out is None else out.when(key.isin(*texts), F.lit(number))
    if out is None:
        return F.lit(default).cast("double")
    return out if default is None else out.otherwise(F.lit(float(default)))


def scale(c: Column | str, spec: Mapping) -> Column:
    """`recode` by one entry of ``vocabulary.SCALES``."""
    return recode(c, spec["values"], spec["default"], spec["lower"])


def score_any(c: Column | str, hits: Sequence, points: float = 1.0) -> Column:
    """`points` where the value is one of `hits`, else 0 (null counts as a miss)."""
    return F.when(as_col(c).isin(*hits), F.lit(points)).otherwise(F.lit(0.0))


def flag(c: Column | str, yes: str = "Yes") -> Column:
    return score_any(c, [yes])


# --- text -------------------------------------------------------------------

def hhmm_to_minutes(c: Column | str, fallback: str = "null") -> Column:
    """``"HH:MM"`` to minutes. Text without a colon gives null, 0 (``"zero"``)
    or its own number (``"number"``); unreadable parts give null."""
    c = as_col(c).cast("string")
    parts = F.split(c, ":")
    minutes = F.get(parts, 0).try_cast("int") * 60 + F.get(parts, 1).try_cast("int")
    other = {"null": F.lit(None).cast("double"), "zero": F.lit(0.0), "number": c.try_cast("double")}[fallback]
    return F.when(F.contains(c, F.lit(":")), minutes.cast("double")).otherwise(other)


def title_case(c: Column | str) -> Column:
    """Trim, then title-case each letter that follows a non-letter (``ß`` gives ``Ss``)."""
    runs = F.regexp_extract_all(F.lower(F.btrim(as_col(c), F.lit(" \t\r\n\f"))), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))

    def raise_first(word: Column) -> Column:
        upper = F.upper(F.substring(word, 1, 1))
        rest = F.lower(upper.substr(F.lit(2), F.length(upper)))
        return F.concat(F.substring(upper, 1, 1), rest, word.substr(F.lit(2), F.length(word)))

    return F.array_join(F.transform(runs, raise_first), "")


def strip_char(c: Column | str, code: int = 13) -> Column:
    return F.replace(as_col(c), F.chr(F.lit(code)), F.lit(""))


def snake(c: Column | str) -> Column:
    return F.replace(as_col(c), F.lit(" "), F.lit("_"))


def unsnake(c: Column | str) -> Column:
    return F.replace(as_col(c), F.lit("_"), F.lit(" "))


# --- numbers ----------------------------------------------------------------

def null_outside(c: Column | str, low: float, high: float) -> Column:
    c = as_col(c)
    return F.when(in_range(c, low, high), c)


def in_range(c: Column | str, low: float, high: float) -> Column:
    c = as_col(c)
    tests = []
    if not math.isinf(low):
        tests.append(c >= F.lit(low))
    if not math.isinf(high):
        tests.append(c <= F.lit(high))
    out = c.isNotNull()
    for t in tests:
        out = out & t
    return out


def row_sum(*cols: Column | str) -> Column:
    """Sum across columns, null if any is null."""
    out = as_col(cols[0])
    for c in cols[1:]:
        out = out + as_col(c)
    return out


def row_mean(*cols: Column | str) -> Column:
    """Mean across columns over the values present."""
    present = [as_col(c) for c in cols]
    top = sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in present), F.lit(0.0))
    n = sum((c.isNotNull().cast("int") for c in present), F.lit(0))
    return F.try_divide(top, n)


def safe_ratio(top: Column | str, bottom: Column | str) -> Column:
    bottom = as_col(bottom)
    return F.when(bottom > 0, as_col(top) / bottom).otherwise(F.lit(0.0))


def weighted_score(weights: Mapping[str, float]) -> Column:
    return sum((as_col(c) * F.lit(float(w)) for c, w in weights.items()), F.lit(0.0))


def clipped_index(score: Column, top: float, span: float = 10.0) -> Column:
    """Clip to [0, top], then stretch to [0, span]; null stays null."""
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(float(top)), score)) * span / top)


# --- bins -------------------------------------------------------------------

def bin_fixed(c: Column | str, edges: Sequence[float], labels: Sequence) -> Column:
    """Right-closed bins ``(a, b]``; null outside."""
    c = as_col(c)
    inside = F.when(c.isNull(), F.lit(None))
    if not math.isinf(edges[0]):
        inside = inside.when(c <= F.lit(edges[0]), F.lit(None))
    for high, label in zip(edges[1:], labels):
        inside = inside.when(F.lit(True) if math.isinf(high) else c <= F.lit(high), F.lit(label))
    return inside


def bin_ordinal(c: Column | str, edges: Sequence[float]) -> Column:
    """Position of the right-closed bin, for sorting by bin."""
    return bin_fixed(c, edges, list(range(len(edges) - 1)))


def bin_left_closed(c: Column | str, edges: Sequence[float], labels: Sequence) -> Column:
    """``labels[0]`` below ``edges[0]``, ``labels[i]`` in ``[edges[i-1], edges[i])``, the last above."""
    c = as_col(c)
    out = F.when(c.isNull(), F.lit(None))
    for edge, label in zip(edges, labels):
        out = out.when(c < F.lit(edge), F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def bin_case(c: Column | str, tops: Sequence[tuple[float, str]], rest: str) -> Column:
    """First group whose inclusive top holds the value; the rest and null go to `rest`."""
    c = as_col(c)
    out = None
    for top, label in tops:
        out = F.when(c <= top, label) if out is None else out.when(c <= top, label)
    return out.otherwise(rest)
