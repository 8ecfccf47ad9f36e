"""Embedding near-dedup with a pivot-permutation index.

Reference points (pivots) are a bounded sample of vectors less their mean, thinned so that none are alike (less strictly where
the vectors would leave few); their number grows with the fourth root of the table. Every vector, less that mean, is described
by the order of its nearest pivots; the inverted lists hold, for each few pivots (four, or less), the vectors that have all of them
among their nearest, so that vectors in one list share as many pivots at least. How many are nearest and shared is the first of
SHAPES that finds RECALL of pairs at the least cosine, measured on the sample with such a partner made for each vector. Vectors
of a list are verified by cosine in double precision. A pair that shares more pivots meets in several lists; it counts only in
that of its least common pivots, so links are counted without making pairs. Lists beyond LIST vectors are dealt as pairs of chunks.

Vectors with equal components are one class first, with its number of copies. Cases: null or empty vectors, zero
vectors, and vectors with null or non-finite components link with nothing; vectors link with those of their own length only, each
length has an index; vectors are scaled by their largest component first, so that none is too long or short for its square; rows
that repeat a vec_id are vectors of their own with one component; a null vec_id links with nothing; empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations as choose

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import discard, enrich, materialize, partitions, release, ship
from folioscope.llm.components import components

#: So many pivots for up to MILLION vectors, more beyond, and at most.
PIVOTS, MILLION, MOST_PIVOTS = 256, 1_000_000, 1024
#: Pivots come from so many vectors a pivot with the least hashes of their ids; none has a cosine over the first of these
#: with another that leaves enough pivots.
SAMPLE, APART = 16, (0.6, 0.7, 0.8, 0.9, 0.95, 0.99)
#: Nearest pivots, and how many of them vectors of a list share; the later ones find more and compare more.
SHAPES, RECALL, TRIED = ((8, 4), (10, 4), (8, 3), (10, 3), (8, 2), (10, 2)), 0.97, 2000
COSINE = 0.95
LIST = 1024
#: Vectors of one table have at most so many lengths.
LENGTHS = 64


def unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(float)
    return x / np.sqrt((x * x).sum(1))[:, None]


def nearest(x: np.ndarray, pivots: np.ndarray, mean: np.ndarray, many: int) -> np.ndarray:
    """The numbers of the nearest pivots, in rising order."""
    return np.sort(np.argsort(-((x - mean) @ pivots.T), axis=1, kind="stable")[:, :many], axis=1).astype(np.int64)


def choose_shape(x: np.ndarray, pivots: np.ndarray, mean: np.ndarray) -> tuple[int, int]:
    """The first of SHAPES that finds RECALL of the partners at COSINE, one for each vector in a random direction."""
    side = np.random.default_rng(11).normal(size=x.shape)
    side -= (side * x).sum(1)[:, None] * x
    side /= np.maximum(np.sqrt((side * side).sum(1)), 1e-300)[:, None]
    y = COSINE * x + np.sqrt(1 - COSINE * COSINE) * side
    for many, shared in SHAPES:
        a, b = nearest(x, pivots, mean, many), nearest(y, pivots, mean, many)
        if ((a[:, :, None] == b[:, None, :]).sum((1, 2)) >= min(shared, len(pivots))).mean() >= RECALL:
            break
    return many, shared


def choose_pivots(classes: DataFrame, dim: int, wanted: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """At most wanted unit vectors, unlike each other, the mean that they are taken from, and the shape of the lists."""
    rows = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * wanted).select("v").collect()
    x = every = unit(np.array([r["v"] for r in rows], float).ravel(), dim)
    mean = x.mean(0) if len(x) > 1 else np.zeros(dim)
    x = x - mean
    length = np.sqrt((x * x).sum(1))
    x = x[length > 1e-9] / length[length > 1e-9, None]
    kept: list[int] = []
    for apart in APART:
        for i in range(len(x)):
            if len(kept) == wanted:
                break
            if i not in kept and (not kept or (x[kept] @ x[i]).max() <= apart):
                kept.append(i)
        if len(kept) >= min(wanted, len(x)):
            break
    return x[kept], mean, choose_shape(every[:TRIED], x[kept], mean)


def describe(pivots: np.ndarray, mean: np.ndarray, shape: tuple[int, int], dim: int):
    """(id, size, near, v, keys) of each vector: the numbers of its nearest pivots in rising order, the vector at
    length one as doubles, and a key for each few of these pivots."""
    many, shared = min(shape[0], len(pivots)), min(shape[1], len(pivots))
    few = np.array(list(choose(range(many), shared)), np.int64).reshape(-1, shared)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch.column(2).flatten().to_numpy(zero_copy_only=False), dim)
            near = nearest(x, pivots, mean, many)
            keys = np.zeros((len(x), len(few)), np.int64)
            for c in few.T:
                keys = keys * (MOST_PIVOTS + 1) + near[:, c] + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.astype("<u2").tobytes() for v in near], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], names=["id", "size", "near", "v", "keys"])

    return run


def first_list(near: np.ndarray, key: int) -> np.ndarray:
    """For each pair of vectors of a list whether the key's pivots are the least that they share."""
    pivots = []
    while key:
        pivots.append(key % (MOST_PIVOTS + 1) - 1)
        key //= MOST_PIVOTS + 1
    if not pivots:
        return np.ones((len(near), len(near)), bool)
    low = np.setdiff1d(np.arange(max(pivots)), pivots)
    has = np.zeros((len(near), max(pivots) + 1), np.float32)
    inside = near <= max(pivots)
    has[np.nonzero(inside)[0], near[inside]] = 1
    has = has[:, low]
    return has @ has.T == 0


def count_links(dim: int):
    """(a, b, n): b = a counts n other vectors linked with a; else a link between components of a list."""

    def run(data: pa.Table) -> pa.Table:
        data = data.sort_by([("key", "ascending"), ("id", "ascending")])
        key = data.column("key").to_numpy()
        ids, size, chunk, other = (data.column(c).to_numpy() for c in ("id", "size", "chunk", "other"))
        v = np.frombuffer(b"".join(data.column("v").to_pylist()), float).reshape(-1, dim)
        near = np.frombuffer(b"".join(data.column("near").to_pylist()), "<u2").reshape(len(key), -1).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        total = np.zeros(len(key), np.int64)
        a, b = [], []
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi - lo < 2:
                continue
            x = v[lo:hi]
            linked = x @ x.T >= COSINE
            np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            some = np.flatnonzero(linked.any(1))
            linked = linked[np.ix_(some, some)] & first_list(near[lo:hi][some], int(key[lo]))
            if chunk[lo] != other[lo]:  # pairs within a chunk count where that chunk is alone
                here = chunk[lo:hi][some]
                linked &= here[:, None] != here[None, :]
            total[lo:hi][some] += linked @ size[lo:hi][some]
            label = np.arange(len(some))
            while True:
                least = np.where(linked, label[None, :], len(some)).min(1)
                new = np.minimum(label, least)
                new = new[new]
                if (new == label).all():
                    break
                label = new
            moved = np.flatnonzero(label != np.arange(len(some)))
            a += ids[lo:hi][some][moved].tolist()
            b += ids[lo:hi][some][label[moved]].tolist()
        got = np.flatnonzero(total)
        each, where = np.unique(ids[got], return_inverse=True)
        sums = np.bincount(where, total[got], len(each)).astype(np.int64)
        return pa.table([pa.array(np.concatenate([each, np.array(a, np.int64)]), pa.int64()), pa.array(np.concatenate([each, np.array(b, np.int64)]), pa.int64()), pa.array(np.concatenate([sums, np.zeros(len(a), np.int64)]), pa.int64())], names=["a", "b", "n"])

    return run


def links_of(classes: DataFrame, dim: int, n: int) -> DataFrame:
    """(a, b, n) of count_links for vectors of one length."""
    spark = classes.sparkSession
    wanted = min(MOST_PIVOTS, int(PIVOTS * max(1.0, n / MILLION) ** 0.25))
    pivots, mean, shape = choose_pivots(classes, dim, wanted)
    described = materialize(classes.select("id", "size", "v").mapInArrow(describe(pivots, mean, shape, dim), "id long, size long, near binary, v binary, keys array<long>"), "described")
    posted = described.select(F.explode("keys").alias("key"), "id")
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", F.ceil(F.col("c") / LIST).cast("int").alias("chunks"))
    dealt = posted.join(lists, "key").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    dealt = dealt.join(described.drop("keys").hint("merge"), "id")
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    bins = max(partitions(spark), 1) * 4
    bin_ = F.when(F.col("chunks") == 1, F.concat(F.lit("s"), F.pmod(F.xxhash64("key"), F.lit(bins)))).otherwise(F.concat_ws("/", "key", F.least("chunk", "other"), F.greatest("chunk", "other")))
    found = materialize(dealt.select(bin_.alias("bin"), "key", "id", "size", "chunk", "other", "near", "v").groupBy("bin").applyInArrow(count_links(dim), "a long, b long, n long"), "links")
    discard(described)
    release(spark)
    return found


def decide(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(finite, F.lit(False)) & F.col("vec_id").isNotNull(), F.col("v")))
    rows = rows.withColumn("most", F.array_max(F.transform("v", lambda x: F.abs(x))))
    # zero has one sign, and the least numbers are brought up before they divide
    rows = rows.withColumn("v", F.expr("transform(v, x -> CASE WHEN most < 1e-290D THEN (x * 1e200D) / (most * 1e200D) ELSE x / most END + 0.0D)")).drop("most")
    rows = rows.withColumn("h", F.xxhash64("v")).withColumn("h2", F.hash("v"))
    classes = materialize(rows.filter("v is not null").groupBy("h", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size"), F.min("v").alias("v")), "vectors")
    lengths = classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy("d").collect()
    if len(lengths) > LENGTHS:
        raise ValueError(f"vectors of {len(lengths)} lengths")
    found = spark.createDataFrame([], "a long, b long, n long")
    for r in lengths:
        found = found.unionByName(links_of(classes.filter(F.size("v") == r["d"]), r["d"], r["n"]))
    counts = found.filter("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    parts = components(found.filter("a <> b").select("a", "b"))
    known = classes.select("h", "h2", "id", "size").join(counts, "id", "left").join(parts, "id", "left")
    known = materialize(known.select("h", "h2", "size", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")), "known")
    total = known.agg(F.sum("size")).first()[0] or 0
    slim = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.col("h")).alias("h"), F.when(F.col("v").isNotNull(), F.col("h2")).alias("h2"))
    every = enrich(slim, known, ["h", "h2"], F.col("size") * 1000 >= F.lit(total))
    component = F.coalesce("component", "vec_id")
    return every.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
