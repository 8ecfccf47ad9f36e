"""Mixing sources to target weights by entropy balancing.

Each source has a target in words. Among all document rates r >= 0 with sum(size * r) = target in each source, the
one nearest to "every document once" in size-weighted relative entropy is r = exp(lambda of its source). The convex dual
is solved by damped Newton steps. Its gradient and Hessian are sums over documents of size * exp(lambda): as a document
loads on one constraint, they are one partial sum a source, taken in parallel; the steps then run on each source's row.
Rates become whole copies by systematic rounding along documents ordered by falling size: the error of a source is
below one document, and of 16 starting points that with the least error is taken. Ranks come from counts by (source,
size, salt), so that no window sees more than 1/256 of a hot source's equal sizes. Only DataFrame operations.

Cases: a null text has size 0; a null source is a source of its own, the last; sources of no words have target 0; a
repeated row is a document of its own; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import WORD_RE

WEIGHTS = (5, 2, 1)
CAP = 3
STARTS = 16
STEPS = 80
#: The dual is solved when no source is off by more than this share of its words; else the query fails.
TOLERANCE = 1e-10


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def source_table(sized: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(__none, __key, __total, __target, __rate), one row a source. Windows here see one row a source."""
    per = sized.groupBy("__none", "__key").agg(F.sum("__size").alias("__total"))
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.partitionBy().orderBy("__none", "__key"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("__w", weight.cast("double"))
    # sources in the order in which a growing share fills them; the excess of full ones goes to the others
    line = Window.partitionBy().orderBy(F.col("__total") * cap / F.col("__w"), "__none", "__key")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("__all", F.sum("__total").over(everything).cast("double"))
        .withColumn("__full", F.coalesce(F.sum(F.col("__total") * cap).over(before), F.lit(0)).cast("double"))
        .withColumn("__left", F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    )
    level = (F.col("__all") - F.col("__full")) / F.col("__left")
    fits = level * F.col("__w") <= F.col("__total") * cap
    per = per.withColumn("__level", F.min(F.when(fits, F.struct(F.col("__full"), level.alias("v")))).over(everything)["v"])
    target = F.least(F.col("__level") * F.col("__w"), (F.col("__total") * cap).cast("double"))
    per = per.withColumn("__target", F.coalesce(target, F.lit(0.0)))
    return per.withColumn("__rate", balanced_rate(F.col("__total"), F.col("__target"), cap)).select("__none", "__key", "__total", "__target", "__rate")


def balanced_rate(total: Column, target: Column, cap: int) -> Column:
    """exp of the dual solution, to nine decimals; an error where STEPS do not reach TOLERANCE."""

    def step(x, _):
        mass = total * F.exp(x)  # the Hessian; the gradient is mass - target
        return x - F.least(F.greatest((mass - target) / mass, F.lit(-1.0)), F.lit(1.0))

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(0.0), step)
    rate = F.floor(F.exp(solved) * 1e9 + 0.5) / F.lit(1e9)
    solved_well = F.abs(total * F.exp(solved) - target) <= total * TOLERANCE
    checked = F.when(solved_well, F.least(rate, F.lit(float(cap)))).otherwise(F.raise_error(F.lit("entropy balancing did not converge")).cast("double"))
    return F.when((total > 0) & (target > 0), checked).otherwise(F.lit(0.0))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """docs with __size, __total, __target (of the source), __rate and __copies."""
    source = F.col("source").cast("string")
    sized = docs.withColumns({"__size": words_in(F.col("text")), "__none": source.isNull(), "__key": F.coalesce(source, F.lit("")), "__id": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))})
    sized = sized.withColumn("__salt", F.substring(F.md5(F.col("__id").cast("binary")), 1, 2))
    return place(sized, docs.columns, weights, cap)


def place(sized: DataFrame, columns: list[str], weights, cap: int) -> DataFrame:
    keys = ["__none", "__key", "__size", "__salt"]
    lean = sized.select(*keys)
    counts = lean.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    # two levels: the sizes of a source in order, then the salts of a size, so that no window holds documents
    by_size = counts.groupBy("__none", "__key", "__size").agg(F.sum("__n").alias("__m"))
    line = Window.partitionBy("__none", "__key").orderBy(F.desc("__size")).rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.withColumn("__above", F.coalesce(F.sum("__m").over(line), F.lit(0))).drop("__m")
    salts = Window.partitionBy("__none", "__key", "__size").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__first", F.coalesce(F.sum("__n").over(salts), F.lit(0)))
    sources = source_table(counts.select("__none", "__key", (F.col("__size") * F.col("__n")).alias("__size")), weights, cap)
    plan = counts.join(by_size, ["__none", "__key", "__size"]).join(sources, ["__none", "__key"])
    base = F.floor("__rate")
    part = F.col("__rate") - base
    lo, hi = F.col("__above") + F.col("__first"), F.col("__above") + F.col("__first") + F.col("__n")
    # words that each starting point would add: whole groups of equal documents at a time
    tries = [F.sum(F.col("__size") * (F.floor(hi * part + k / STARTS) - F.floor(lo * part + k / STARTS))).alias(f"__t{k}") for k in range(STARTS)]
    missing = F.max(F.col("__target") - F.col("__total") * base)
    best = plan.groupBy("__none", "__key").agg(missing.alias("__missing"), *tries)
    errors = F.array(*[F.struct(F.abs(F.col(f"__t{k}") - F.col("__missing")).alias("e"), F.lit(k).alias("k")) for k in range(STARTS)])
    best = best.select("__none", "__key", (F.array_min(errors)["k"] / F.lit(float(STARTS))).alias("__start"))
    plan = plan.join(best, ["__none", "__key"]).select(*keys, lo.alias("__lo"), "__total", "__target", "__rate", "__start")
    rank = F.col("__lo") + F.row_number().over(Window.partitionBy(*keys).orderBy("__id"))
    ranked = sized.join(plan.hint("merge"), keys).withColumn("__rank", rank)
    extra = F.floor(F.col("__rank") * part + F.col("__start")) - F.floor((F.col("__rank") - 1) * part + F.col("__start"))
    return ranked.withColumn("__copies", (base + extra).cast("long")).select(*columns, "__size", "__total", "__target", "__rate", "__copies")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Each document as often as the mix takes it."""
    many = mix(docs, weights, cap).filter("__copies > 0")
    return many.withColumn("__copy", F.explode(F.expr("sequence(1, cast(__copies as int))"))).select(*docs.columns)
