"""Column expressions over text: literal code points, only white space is ever collapsed."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

# Fixed values -------------------------------------------------------------
#: Unicode white space as a Java class: ASCII space, the four separators, next line, and the Unicode space categories.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: Characters whose loss changes a dimension.
CRITICAL = "Ø⌀∅Φφ±°×÷≤≥μµ²³′″−+-."
#: The wider set by which a change of reading is critical.
CHANGE = r"[0-9Ø⌀∅Φφ±+\-−.,×x°²³⁰¹⁴⁵⁶⁷⁸⁹⁺⁻]"
#: A plain number, with an optional diameter sign and an optional sign.
NUMBER = r"(?U)^[Ø⌀∅Φφ]?[+\-−]?(?:\d+(?:[.,]\d*)?|[.,]\d+)\z"
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"
HAN_OR_YIJING = r"[\x{3400}-\x{9fff}]"
EAST_ASIAN = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}]"
FULL_WIDTH = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}]"
ASCII_WORD = r"[A-Za-z0-9]"
SECRETS = (
    r"-----BEGIN (?:RSA |OPENSSH |EC )?PRIVATE KEY-----",
    r"\bgh[pousr]_[A-Za-z0-9]{30,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{40,}\b",
    r"\bAKIA[A-Z0-9]{16}\b",
)
#: Bits of columns that an alignment keeps for its way back.
KEPT_BITS = 1 << 26
LINK = r'!?\[[^\]]*\]\((<[^>]+>|[^\s)]+)(?:\s+"[^"]*")?\)'
# --------------------------------------------------------------------------

CRITICAL_CLASS = "[" + "".join("\\" + c if c in "-+." else c for c in CRITICAL) + "]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row: the optimizer puts a column's expression wherever the column is named, into lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c) -> Column:
    return F.regexp_replace(_col(c), rf"^{SPACE}+|{SPACE}+\z", "")


def normalize(c) -> Column:
    """Runs of white space become one space, none at the ends; null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), SPACE + "+", " "))


def ink_length(c) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(F.coalesce(_col(c), F.lit("")), SPACE + "+", ""))


def edit_distance(a, b) -> Column:
    return F.levenshtein(_col(a), _col(b))


def critical_count(c) -> Column:
    return F.regexp_count(_col(c), F.lit(CRITICAL_CLASS))


def critical_reading(c) -> Column:
    """The characters, in order, whose change is critical."""
    return F.regexp_extract_all(_col(c), F.lit(CHANGE), F.lit(0))


def _advance(places: dict[str, int], text: str, up: int, down: int, full: int, keep: list | None = None) -> tuple[int, int]:
    """up and down after the columns of text: bits of the rows whose distance is one above and one below that of the row before.

    keep takes (zero, up) of each column; zero: bits of the rows whose distance is that of their upper left neighbour.
    """
    for c in text:
        same = places.get(c, 0)
        zero = (((same & up) + up ^ up) | same | down) & full
        right = (down | full ^ (zero | up)) << 1 | 1
        up, down = ((zero & up) << 1 | ~(zero | right)) & full, zero & right
        if keep is not None:
            keep.append((zero, up))
    return up, down


def aligned(reference: str, prediction: str) -> tuple[int, int]:
    """Edits and critical errors: distances a column of bits at a time, then one way back through them.

    The way back keeps the bits of KEPT_BITS / len(reference) columns, or of as many as there are blocks of them if that is more, and computes earlier
    blocks anew from the columns at their borders.
    """
    n, m = len(reference), len(prediction)
    while n and m and reference[n - 1] == prediction[m - 1]:  # a common end is aligned with itself
        n, m = n - 1, m - 1
    if not n or not m:
        return n + m, sum(c in CRITICAL for c in reference[:n])
    bits: dict[str, bytearray] = {}
    for i, c in enumerate(reference[:n]):
        bits.setdefault(c, bytearray(n + 7 >> 3))[i >> 3] |= 1 << (i & 7)
    places = {c: int.from_bytes(b, "little") for c, b in bits.items()}
    full = (1 << n) - 1
    block = max(math.isqrt(m) + 1, KEPT_BITS // n)
    starts = range(0, m, block)
    weighty = bool(bits.keys() & set(CRITICAL))
    borders, state, kept = [], (full, 0), []
    for start in starts:
        borders.append(state)
        state = _advance(places, prediction[start : min(start + block, m)], *state, full, kept if weighty and start == starts[-1] else None)
    edits = m + state[0].bit_count() - state[1].bit_count()
    if not weighty:
        return edits, 0
    i, j, start, critical = n, m, starts[-1], 0
    while i and j:
        if j == start:
            start, kept = start - block, []
            _advance(places, prediction[start:j], *borders[start // block], full, kept)
        c, (zero, up) = reference[i - 1], kept[j - start - 1]
        if c == prediction[j - 1]:
            i, j = i - 1, j - 1
        elif not zero >> (i - 1) & 1:  # replaced
            critical, i, j = critical + (c in CRITICAL), i - 1, j - 1
        elif up >> (i - 1) & 1:  # lost
            critical, i = critical + (c in CRITICAL), i - 1
        else:
            j -= 1
    return edits, critical + sum(c in CRITICAL for c in reference[:i])


@F.pandas_udf(T.StructType([T.StructField("edits", T.IntegerType()), T.StructField("critical_errors", T.IntegerType())]))
def _edit_counts(references: pd.Series, predictions: pd.Series) -> pd.DataFrame:
    out = [(None, None) if a is None or b is None else aligned(a, b) for a, b in zip(references, predictions)]
    return pd.DataFrame(out, columns=["edits", "critical_errors"]).astype("Int32")


def edit_counts(reference, prediction) -> Column:
    """struct(edits, critical_errors) of one alignment: on ties a substitution, then a loss, then an insertion.

    A critical character of the reference that is replaced or lost is an error; an insertion never is.
    """
    return _edit_counts(_col(reference), _col(prediction))


def character_width(c, size: Column | float, latin: Column | float) -> Column:
    """Estimated width of a line: each class of characters by its count."""
    text = F.coalesce(_col(c), F.lit(""))
    size, latin = (x if isinstance(x, Column) else F.lit(float(x)) for x in (size, latin))
    count = lambda rx: F.regexp_count(text, F.lit(rx))
    spaces, wide, word = count(SPACE), count(FULL_WIDTH), count(ASCII_WORD)
    other = F.length(text) - spaces - wide - word
    return size * (spaces * 0.28 + wide + word * latin + other * F.greatest(F.lit(0.42), latin * 0.8))


def line_width(c, size, latin, measured: Column | None = None) -> Column:
    """Width with the renderer's allowance; a positive measured width of a real font takes the estimate's place."""
    estimate = character_width(c, size, latin)
    if measured is not None:
        estimate = F.when(measured > 0, measured).otherwise(estimate)
    return estimate * F.when(F.coalesce(_col(c), F.lit("")).rlike(EAST_ASIAN), 1.06).otherwise(1.04)


def wrapped_lines(c, width, size, latin) -> Column:
    width = width if isinstance(width, Column) else F.lit(float(width))
    lines = F.ceil(character_width(c, size, latin) / F.greatest(width, F.lit(1.0)))
    return F.greatest(F.lit(1), lines.cast("int"))


def has_secret(c) -> Column:
    out = F.lit(False)
    for rx in SECRETS:
        out = out | _col(c).rlike(rx)
    return out


def markdown_links(c) -> Column:
    """Targets of links and images, without angle brackets and titles."""
    return F.transform(F.regexp_extract_all(_col(c), F.lit(LINK), F.lit(1)), lambda t: F.regexp_replace(t, r"^<+|>+\z", ""))


def is_digest(c) -> Column:
    return F.coalesce(_col(c).rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def is_number(c) -> Column:
    return F.replace(_col(c), F.lit(" "), F.lit("")).rlike(NUMBER)
