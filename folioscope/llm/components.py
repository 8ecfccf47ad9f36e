"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from folioscope.llm.common import discard, enrich, materialize, release, tidied

#: A node with a thousandth of all links is a hub; there are at most two thousand.
HUB_SHARE = 1000
#: A chain's length falls by a root in each round, so that no table of this world needs as many.
ROUNDS = 200


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def forest(batches):
    """Links of a partition, with each id tied to the least one that it reaches there: never more links than ids."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    a, b = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
    ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = where[: len(a)], where[len(a) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["a", "b"])


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The links as a table, and three sums over them, taken as they are written."""
    seen = Observation()
    code = F.xxhash64("a", "b")
    table = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(code).alias("x"), F.sum((code % 1000003).cast("long")).alias("s")), "edges")
    return table, (seen.get["n"], seen.get["x"], seen.get["s"])


def _least(edges: DataFrame, total: int) -> DataFrame:
    """edges with m, the least b of their a; the edges of hubs are not gathered."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("__n"))
    return enrich(edges, least, ["a"], F.col("__n") * HUB_SHARE >= F.lit(total), "inner").drop("__n")


def components(links: DataFrame, most: int = ROUNDS) -> DataFrame:
    """(id, component): the smallest id that each linked id reaches, for links (a, b) of long ids.

    Links are first thinned within each partition. Each round ties the larger neighbours of every node to its least neighbour, then the smaller ones; a chain's length
    falls by a root, a star takes one round. Rounds are written to the shared folder and the one before is deleted; nothing but
    three sums reaches the driver. Raises if links still change after most rounds.
    """
    given = materialize(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b"), "links")
    edges, state = _written(_directed(given.mapInArrow(tidied(forest), "a long, b long")))
    discard(given)
    for _ in range(most):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least(both, 2 * state[0]).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = materialize(_directed(large), "stars")
        small = _least(large, state[0])
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        new, now = _written(_directed(small))
        discard(edges, large)
        edges = new
        release(links.sparkSession)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"links still change after {most} rounds")
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
