"""Placeholders that carry literals unchanged through any rewriting of the text around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the form of a placeholder.
TOKEN = r"__LITERAL_\d+_[0-9A-F]{12}__"


def seal(raw: Column) -> Column:
    return F.upper(F.substring(F.sha2(raw.cast("binary"), 256), 1, 12))


def protect(source: Column, spans: Column) -> Column:
    """struct(source, request, raw, tokens, error): spans (array of struct(start, end), zero-based) become placeholders.

    A span that is empty, overlaps another or leaves the text, or a text that already holds a placeholder, gives an error and no request.
    """
    ordered = F.array_sort(spans)
    state = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"), F.lit("").alias("out"), F.array().cast("array<string>").alias("raw"), F.array().cast("array<string>").alias("tokens")),
        lambda s, x: F.struct(
            x["end"].alias("at"),
            (s["ok"] & (s["at"] <= x["start"]) & (x["start"] < x["end"]) & (x["end"] <= F.length(source))).alias("ok"),
            F.concat(s["out"], _slice(source, s["at"], x["start"]), _token(F.size(s["raw"]), _slice(source, x["start"], x["end"]))).alias("out"),
            F.concat(s["raw"], F.array(_slice(source, x["start"], x["end"]))).alias("raw"),
            F.concat(s["tokens"], F.array(_token(F.size(s["raw"]), _slice(source, x["start"], x["end"])))).alias("tokens"),
        ),
    )
    error = F.when(~state["ok"], "overlapping or invalid span").when((F.size(ordered) > 0) & source.rlike(TOKEN), "source collides with placeholder namespace")
    good = error.isNull()
    return F.struct(
        source.alias("source"),
        F.when(good, F.concat(state["out"], _slice(source, state["at"], F.length(source)))).alias("request"),
        F.when(good, state["raw"]).alias("raw"),
        F.when(good, state["tokens"]).alias("tokens"),
        error.alias("error"),
    )


def _slice(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def _token(index: Column, raw: Column) -> Column:
    return F.concat(F.lit("__LITERAL_"), index.cast("string"), F.lit("_"), seal(raw), F.lit("__"))


def restore(plan: Column, candidate: Column, allow_reordering: bool = False) -> Column:
    """struct(text, ok): the candidate with literals back in place, or the source if any placeholder is not there exactly once and intact."""
    actual = F.regexp_extract_all(candidate, F.lit(TOKEN), F.lit(0))
    expected = plan["tokens"]
    same = F.array_sort(actual) == F.array_sort(expected) if allow_reordering else actual == expected
    once = F.size(F.array_distinct(actual)) == F.size(actual)
    sealed = F.forall(F.arrays_zip(expected.alias("t"), plan["raw"].alias("r")), lambda x: F.contains(x["t"], seal(x["r"])))
    ok = F.coalesce(same & once & sealed, F.lit(False))
    pairs = F.arrays_zip(expected.alias("t"), plan["raw"].alias("r"))
    text = F.aggregate(pairs, candidate, lambda s, x: F.replace(s, x["t"], x["r"]))
    return F.struct(F.when(ok, text).otherwise(plan["source"]).alias("text"), ok.alias("ok"))
