"""MinHash near-dedup with tensored banding.

Two collections of 18 hashes, each of three minhashes, are computed; the keys of the 324 tables are the pairs (one of
each collection), six minhashes a key out of 108 in all. Documents at similarity 0.75 share a table but for one pair in
ten thousand. Only hashes that another document shares enter pairs, so most documents make no key. Documents with equal
shingle sets are one class first. Classes that share keys form candidate groups; in each group links are confirmed on full sets.

A group is verified with no list of pairs: a central member is compared with all others at once, then each member outside
the largest component so far, which leaves no pair of different components uncompared. Groups beyond GROUP members are
dealt as pairs of chunks, so that no task holds more than two chunks. Shingle sets are 64-bit hashes of five words.

Cases: null and empty texts and texts without words have no shingle and link with nothing; texts of fewer than five words
have one shingle, the whole; rows that repeat a doc_id are one document, linked by each of its texts; rows with a null doc_id are linked with nothing and
stay; empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import SLICE, Words, discard, enrich, grams, materialize, mix, partitions, release, ship, slices, split_by_ids, text_buffer, tidied
from folioscope.llm.components import components

SHINGLE = 5
SIDES, TABLES, ROWS = 2, 18, 3
GROUP = 2048
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A class with a thousandth of all rows is hot; there are at most so many.
HOT_SHARE = 1000
FILTER_BITS = 1 << 25

_RNG = np.random.default_rng(52)
FLIP = _RNG.integers(0, 2**32, SIDES * TABLES * ROWS, dtype=np.uint32)
SPREAD = _RNG.integers(0, 2**31, SIDES * TABLES * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(column):
    """The sorted distinct shingle hashes of each text."""
    buf, offsets = text_buffer(column)
    for a, b in slices(offsets, SLICE):
        w = Words(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], True)
        h = w.hashes()
        g = grams(h, SHINGLE)
        for i in range(b - a):
            lo, hi = int(w.at[i]), int(w.at[i + 1])
            if hi - lo >= SHINGLE:
                yield np.unique(g[lo : hi - SHINGLE + 1])
            elif hi > lo:
                yield grams(h[lo:hi], hi - lo) + np.uint64(hi - lo)
            else:
                yield np.zeros(0, np.uint64)


def minhashes(s: np.ndarray) -> np.ndarray:
    """The hashes of both collections: 2 * 18 numbers, each of three minhashes."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(FLIP), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 2048):
        best = np.minimum(best, ((x[a : a + 2048, None] ^ FLIP) * SPREAD).min(0))
    m = best.reshape(SIDES * TABLES, ROWS).astype(np.uint64)
    h = mix(m[:, 0] | m[:, 1] << np.uint64(32))
    return mix(h ^ (m[:, 2] + (np.arange(SIDES * TABLES, dtype=np.uint64) << np.uint64(33)))).view(np.int64)


def sign(batches):
    for batch in batches:
        n, one, two, first, second = [], [], [], [], []
        for s in shingle_sets(batch.column(1)):
            n.append(len(s))
            one.append(int(s.sum(dtype=np.uint64).view(np.int64)))
            two.append(int(np.bitwise_xor.reduce(mix(s * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)) if len(s) else 0)
            m = minhashes(s) if len(s) else np.zeros(0, np.int64)
            first.append(m[:TABLES])
            second.append(m[TABLES:])
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(first, longs), pa.array(second, longs)], names=["doc_id", "n", "d1", "d2", "a", "b"])


def gather_sets(batches):
    for batch in batches:
        sets = [s.tobytes() for s in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(sets, pa.binary())], names=["id", "grp", "chunk", "chunks", "shingles"])


def linked_labels(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the least index in its component under similarity of PERCENT or more."""
    k = len(sets)
    size = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(size)])
    words, where, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    label = np.arange(k)
    compared = np.zeros(k, bool)
    central = np.add.reduceat(df[where].astype(float), at[:-1]) / size
    order = np.argsort(-central, kind="stable")
    mark = np.zeros(len(words), bool)
    while True:
        largest = np.bincount(label, minlength=k).argmax()
        rest = order[~compared[order]]
        if compared.any():
            rest = rest[label[rest] != largest]
        if not len(rest):
            return label
        p = rest[0]
        compared[p] = True
        mine = where[at[p] : at[p + 1]]
        mark[mine] = True
        common = np.add.reduceat(mark[where].astype(np.int64), at[:-1])
        mark[mine] = False
        linked = 100 * common >= PERCENT * (size + size[p] - common)
        found = np.unique(label[linked])
        label[np.isin(label, found)] = found[0]


def verify(data: pa.Table) -> pa.Table:
    """Links (a, b) that join the components of each group (or pair of chunks of one)."""
    data = data.sort_by([("grp", "ascending"), ("id", "ascending")])
    grp = data.column("grp").to_numpy()
    ids = data.column("id").to_numpy()
    raw = data.column("shingles").to_pylist()
    edges = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1], [True]]))
    a, b = [], []
    for lo, hi in zip(edges[:-1], edges[1:]):
        if hi - lo < 2:
            continue
        label = linked_labels([np.frombuffer(x, np.uint64) for x in raw[lo:hi]])
        moved = np.flatnonzero(label != np.arange(hi - lo))
        a += ids[lo + moved].tolist()
        b += ids[lo + label[moved]].tolist()
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def shared_hashes(classes: DataFrame, column: str) -> DataFrame:
    """For each class its hashes of one collection that another class has too; a hash of many classes gathers no rows."""
    each = classes.select("id", "class", F.explode(column).alias("h"))
    twice = each.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    total = classes.count()
    return enrich(each, twice, ["h"], F.col("c") * HOT_SHARE >= F.lit(total), "inner").groupBy("id", "class").agg(F.collect_set("h").alias(column))


def candidate_links(classes: DataFrame) -> DataFrame:
    """(a, b): each class that shares a table with others, and the least of them."""
    both = materialize(shared_hashes(classes, "a").join(shared_hashes(classes, "b"), ["id", "class"]), "shared")
    keyed = both.select("id", "b", F.explode("a").alias("x")).select("id", "x", F.explode("b").alias("y")).select("id", F.xxhash64("x", "y").alias("key"))
    least = keyed.groupBy("key").agg(F.min("id").alias("m"), F.max("id").alias("top")).filter("m <> top").select("key", "m")
    return keyed.join(least, "key").filter("id <> m").select(F.col("id").alias("a"), F.col("m").alias("b")).distinct()


def maybe_member(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """rows whose id may be among ids: all that are, and others by chance, so that few texts move in the join that decides.

    The bitmap has sixteen bits an id; at most FILTER_BITS / 64 rows are broadcast, and where that would let most rows pass there is none.
    """
    many = 16 * max(ids.count(), 64)
    if many > FILTER_BITS:
        return rows
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(many))
    word = lambda c: F.floor(bit(c) / 64).cast("int")
    mask = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (bit(c) % 64).cast("int"))
    bits = ids.select(word(ids.columns[0]).alias("__word"), mask(ids.columns[0]).alias("__mask")).groupBy("__word").agg(F.bit_or("__mask").alias("__mask"))
    near = rows.withColumn("__word", word(column)).join(F.broadcast(bits), "__word")
    return near.filter(F.col("__mask").bitwiseAND(mask(column)) != 0).select(*rows.columns)


def clusters(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, d1, d2), and classes (d1, d2, n, id, size, component) of those that have shingles and an id."""
    spark = docs.sparkSession
    ship(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(plain.mapInArrow(tidied(sign), "doc_id long, n long, d1 long, d2 long, a array<long>, b array<long>"), "signatures")
    rows = signed.select("doc_id", "n", "d1", "d2")
    some = signed.filter("n > 0 and doc_id is not null")
    classes = materialize(some.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("size")), "classes")
    # a class's hashes follow from its set, so that any of its rows will do, also where an id has several texts
    heads = some.select(F.col("doc_id").alias("id"), "a", "b", "d1", "d2").join(classes.select("id", "d1", "d2"), ["id", "d1", "d2"])
    heads = heads.groupBy("id", F.xxhash64("d1", "d2").alias("class")).agg(F.first("a").alias("a"), F.first("b").alias("b"))
    heads = materialize(heads, "heads")
    release(spark)
    groups = components(candidate_links(heads))
    groups = groups.unionByName(groups.select(F.col("component").alias("id"), "component").distinct())
    groups = materialize(groups, "groups")
    discard(heads)
    release(spark)
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")).select("component", F.ceil(F.col("n") / GROUP).cast("int").alias("chunks"))
    dealt = groups.join(sizes, "component").select("id", F.col("component").alias("grp"), F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), "chunks")
    likely = maybe_member(plain, "doc_id", dealt.select("id"))
    texts = likely.join(dealt.hint("merge"), likely["doc_id"] == dealt["id"]).select(F.col("id"), "text", "grp", "chunk", "chunks")
    sets = texts.mapInArrow(tidied(gather_sets), "id long, grp long, chunk int, chunks int, shingles binary")
    # small groups share tasks; a large one is dealt as pairs of chunks
    bins = max(partitions(spark), 1) * 4
    other = F.explode(F.expr("sequence(0, chunks - 1)"))
    dealt = sets.withColumn("other", other).withColumn("bin", F.when(F.col("chunks") == 1, F.concat(F.lit("s"), F.pmod(F.xxhash64("grp"), F.lit(bins)))).otherwise(F.concat_ws("/", "grp", F.least("chunk", "other"), F.greatest("chunk", "other"))))
    links = dealt.select("bin", "grp", "id", "shingles").groupBy("bin").applyInArrow(verify, "a long, b long")
    final = components(links).select("id", "component")
    release(spark)
    return rows, classes.join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))


def decide(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row."""
    rows, classes = clusters(docs)
    classes = materialize(classes, "classes")
    total = classes.agg(F.sum("size")).first()[0] or 0
    hot = F.col("size") * HOT_SHARE >= F.lit(total)
    keys = ["d1", "d2", "n"]
    few = classes.filter(hot).select(*keys, "component")  # at most HOT_SHARE rows
    first = rows.join(F.broadcast(few), keys, "left")
    known = first.filter("component is not null")
    rest = first.filter("component is null").drop("component").join(classes.filter(~hot).select(*keys, "component").hint("merge"), keys, "left")
    every = known.unionByName(rest)
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return every.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group, with their own columns."""
    gone = materialize(decide(docs).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    sure, others = split_by_ids(docs, "doc_id", gone)
    return sure.unionByName(others.join(gone.hint("merge"), others["doc_id"].cast("long") == gone["__gone"], "left_anti").select(*docs.columns))
