"""Suffix-array dedup of byte strings: sampled splitters, range partitions, multikey quicksort.

A string of LENGTH bytes that starts anywhere else too is removed. Sorting every suffix of the corpus would be hundreds of
times the text, so suffixes are sampled by content: of the LEAD-byte strings in each LENGTH-byte window the one of least
hash is the window's anchor, and equal windows have equal anchors at equal places. An anchor stands for a run of windows; the
bytes of these windows are its context, a suffix that begins at the anchor and what stands before it.

1. Anchors with equal contexts (128-bit digests, counted with partial sums) are one class. All windows of a class that
   occurs more than once repeat. A class that occurs once needs comparing only if its lead occurs in another class.
2. Those classes are range-partitioned by their suffixes, as text, with splitters that Spark samples. Each bucket sorts its
   suffixes by multikey quicksort on eight-byte tokens of the text, reads later tokens only inside ties, and takes the
   longest common prefix of neighbours; what stands before the anchors is sorted and compared likewise, read backwards. A
   window repeats if another context agrees with it on both sides of the anchor.
3. Borders: suffixes that share the lead of a bucket's first or last suffix may go on in the next bucket. Buckets hand these
   on, and they are compared lead by lead.

Leads with more than CROWD classes (a line that a third of all texts hold between different neighbours) are not brought together:
each of their windows becomes a row of its own, counted by digest with partial sums. No key gathers rows without bound.

Cases: null and empty texts have no bytes; matches never cross documents; overlapping matches of one text count; rows that repeat a
doc_id are documents of their own, whole repeated rows are copies of each other; null doc_ids are documents like others; empty
tables give empty results; other columns are not read. kept is binary, as removal may cut characters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import discard, enrich, materialize, mix, partitions, powers, prefix_hash, release, row_key, ship, slices, text_buffer

LENGTH = 400
LEAD = 100
SPREAD = LENGTH - LEAD  # how far before its anchor a window may start
CROWD = 4096
#: Splitters have so many bytes of a suffix; longer than a lead, so that a border may lie within the suffixes of one.
KEY = LEAD + 28
#: Contexts of so many bytes make a bucket on average.
BUCKET_BYTES = 16 << 20
#: Bytes of text whose hashes are held at a time; longer texts are cut with an overlap, which never changes a result.
PIECE = 1 << 19


# ---------------------------------------------------------------- anchors
def find_anchors(buf: np.ndarray, ends: np.ndarray):
    """(at, lo, hi, lead's hash): each anchor stands for the windows that start at lo to hi. ends: of each byte, the end of its text."""
    n = len(buf)
    count = n - LENGTH + 1
    if count <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    prefix = prefix_hash(buf)
    _, down = powers(n + 1)
    heads = mix((prefix[LEAD:] - prefix[:-LEAD]) * down[: n - LEAD + 1])
    low = np.uint64((1 << 24) - 1)
    width = SPREAD + 1
    rows = -(-(count + width - 1) // width)
    key = np.full(rows * width, ~np.uint64(0))
    m = min(len(heads), len(key))
    key[:m] = heads[:m] & ~low | np.arange(m, dtype=np.uint64)
    grid = key.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & low).astype(np.int64)
    start = np.flatnonzero(np.arange(count) + LENGTH <= ends[:count])
    least = least[start]
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (np.diff(start) > 1)])) if len(start) else start
    last = np.append(first[1:], len(start)) - 1
    return least[first], start[first], start[last] if len(start) else start, heads[least[first]]


def pieces(offsets: np.ndarray):
    """(first text, one past the last, first byte, one past the last) of runs of texts, or of overlapping parts of a long one."""
    for a, b in slices(offsets, PIECE):
        lo, end = int(offsets[a]), int(offsets[b])
        while True:
            hi = min(end, lo + PIECE + LENGTH) if b - a == 1 else end
            yield a, b, lo, hi
            if hi == end:
                break
            lo = hi - LENGTH + 1


ANCHORS = "k1 long, k2 long, at int, lo int, hi int, head long, class binary"


def anchor_rows(batches):
    for batch in batches:
        buf, offsets = text_buffer(batch.column(2))
        k1, k2 = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for a, b, lo, hi in pieces(offsets):
            part = buf[lo:hi]
            edge = np.minimum(offsets[a : b + 1], hi)
            ends = np.repeat(edge[1:] - lo, np.diff(np.maximum(edge, lo)))
            at, first, last, head = find_anchors(part, ends)
            if not len(at):
                continue
            doc = np.searchsorted(offsets, at + lo, "right") - 1
            raw = part.tobytes()
            digest = [hashlib.blake2b(raw[x : y + LENGTH], digest_size=16, salt=int(z - x).to_bytes(2, "big")).digest() for x, y, z in zip(first.tolist(), last.tolist(), at.tolist())]
            place = lo - offsets[doc]
            ints = [pa.array((x + place).astype(np.int32)) for x in (at, first, last)]
            yield pa.RecordBatch.from_arrays([pa.array(k1[doc]), pa.array(k2[doc]), *ints, pa.array(head.view(np.int64)), pa.array(digest, pa.binary())], names=["k1", "k2", "at", "lo", "hi", "head", "class"])


CONTEXTS = "k1 long, k2 long, lo int, n long, pre int, head long, context binary, window binary, start int"


def context_rows(batches):
    """Contexts of the wanted anchors of each text; those of crowded leads as a row for each window."""
    names = [c.split()[0] for c in CONTEXTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32()]
    for batch in batches:
        rows: list[tuple] = []
        texts = batch.column(2)
        held = 0
        for i, want in enumerate(batch.column(3)):
            raw = memoryview(texts[i].as_buffer())
            k1, k2 = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            for w in want.as_py():
                lo, hi, pre, n, head = w["lo"], w["hi"], w["at"] - w["lo"], w["n"], w["head"]
                if w["crowded"]:
                    rows += [(k1, k2, lo, n, None, None, None, hashlib.blake2b(raw[s : s + LENGTH], digest_size=16).digest(), s) for s in range(lo, hi + 1)]
                    held += (hi - lo + 1) * 64
                else:
                    rows.append((k1, k2, lo, n, pre, head, bytes(raw[lo : hi + LENGTH]), None, None))
                    held += hi - lo + LENGTH
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


# ---------------------------------------------------------------- sorting and comparing suffixes
def multikey_quicksort(tokens: np.ndarray) -> np.ndarray:
    """The order of rows of tokens. Each open run of rows is split in three by a pivot token (less, equal, greater), all
    runs at a time; the equal ones go on with the next token, so that a token is read only by rows that tie on those before."""
    n, width = tokens.shape
    order = np.arange(n)
    start, size, depth = np.zeros(1, np.int64), np.array([n]), np.zeros(1, np.int64)
    while True:
        open_ = (size > 1) & (depth < width)
        start, size, depth = start[open_], size[open_], depth[open_]
        if not len(start):
            return order
        base = np.cumsum(size) - size
        run = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(run)) - base[run] + start[run]
        rows = order[place]
        t = tokens[rows, depth[run]]
        pivot = t[base + size // 2][run]
        side = np.where(t < pivot, 0, np.where(t == pivot, 1, 2))
        counts = np.bincount(run * 3 + side, minlength=3 * len(size)).reshape(-1, 3)
        to = np.empty(len(run), np.int64)
        shift = np.zeros(len(size), np.int64)
        for s in range(3):
            here = side == s
            before = np.cumsum(here) - here
            rank = before - before[base][run]
            to[here] = (start[run] + shift[run] + rank)[here]
            shift += counts[:, s]
        order[to] = rows
        start = np.stack([start, start + counts[:, 0], start + counts[:, 0] + counts[:, 1]], 1).ravel()
        depth = np.stack([depth, depth + 1, depth], 1).ravel()
        size = counts.ravel()


def tokens_of(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian eight-byte tokens, whose order is that of the text."""
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


def gather(raw: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows of width bytes, forward (step 1) or backward (-1) from start; zero beyond length."""
    j = np.arange(width)
    at = np.clip(start[:, None] + step * j, 0, max(len(raw) - 1, 0))
    return np.where(j < length[:, None], raw[at], np.uint8(0))


def common_prefix(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of sorted rows, how many leading bytes each shares with the next."""
    if len(rows) < 2:
        return np.zeros(0, np.int64)
    differ = rows[1:] != rows[:-1]
    first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.minimum(first, np.minimum(length[1:], length[:-1]))


def neighbours(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Of each row the most that it shares with a neighbour in the order."""
    most = np.zeros(len(order), np.int64)
    most[order[1:]] = shared
    most[order[:-1]] = np.maximum(most[order[:-1]], shared)
    return most


def repeated_windows(contexts: list[bytes], pre: np.ndarray, wanted: np.ndarray):
    """(row, start) of the windows, from the context's first byte, that occur in another context too; and the order of suffixes."""
    n = len(contexts)
    size = np.array([len(c) for c in contexts])
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    base = np.cumsum(size) - size
    right = size - pre
    text = gather(raw, base + pre, right, LENGTH, 1)
    order = multikey_quicksort(np.concatenate([tokens_of(text), right.astype(np.uint64)[:, None]], 1))
    ahead = common_prefix(text[order], right[order])
    lead = np.empty(n, np.int64)
    lead[order] = np.concatenate([[0], np.cumsum(ahead < LEAD)])
    width = SPREAD + -SPREAD % 8
    text = gather(raw, base + pre - 1, pre, width, -1)
    back = multikey_quicksort(np.concatenate([lead.astype(np.uint64)[:, None], tokens_of(text), pre.astype(np.uint64)[:, None]], 1))
    behind = common_prefix(text[back], pre[back])
    behind[lead[back][1:] != lead[back][:-1]] = -1
    # a window with o bytes before the anchor can repeat only if neighbours share as much on both sides
    least = np.maximum(pre - (size - LENGTH), LENGTH - neighbours(order, ahead))
    most = np.minimum(pre, np.maximum(neighbours(back, behind), 0))
    rows, starts = [], []
    for o in range(int(least.min(initial=SPREAD + 1)), int(most.max(initial=-1)) + 1):
        some = np.flatnonzero((least <= o) & (o <= most))
        if len(some) < 2:
            continue
        r, q = np.empty(n, np.int64), np.empty(n, np.int64)
        r[order] = np.concatenate([[0], np.cumsum(ahead < LENGTH - o)])
        q[back] = np.concatenate([[0], np.cumsum(behind < o)])
        _, where, times = np.unique(r[some] * n + q[some], return_inverse=True, return_counts=True)
        hit = some[(times[where] > 1) & wanted[some]]
        rows.append(hit)
        starts.append(pre[hit] - o)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(rows), join(starts), order, lead


SPANS = "k1 long, k2 long, start int, end int"
FOUND = f"{SPANS}, lo int, n long, pre int, head long, context binary"
_FOUND = {"k1": pa.int64(), "k2": pa.int64(), "start": pa.int32(), "end": pa.int32(), "lo": pa.int32(), "n": pa.int64(), "pre": pa.int32(), "head": pa.int64(), "context": pa.binary()}


def compare(data: pa.Table, whole: bool) -> pa.Table:
    """Spans of bytes in repeated windows of classes that occur once. Unless data is whole, suffixes that share the first or
    the last one's lead are handed on with no span."""
    contexts = data.column("context").to_pylist()
    column = lambda c: data.column(c).to_numpy().astype(np.int64)
    pre, lo = column("pre"), column("lo")
    rows, starts, order, lead = repeated_windows(contexts, pre, column("n") == 1)
    on = np.zeros(len(contexts), bool) if whole else (lead == lead[order[0]]) | (lead == lead[order[-1]])
    rows, starts = rows[~on[rows]], starts[~on[rows]]
    by = np.lexsort((starts, rows))
    rows, starts = rows[by], starts[by]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (np.diff(starts) > LENGTH)])) if len(rows) else rows
    last = np.append(first[1:], len(rows)) - 1
    mine = rows[first]
    k1, k2 = column("k1"), column("k2")
    spans = [k1[mine], k2[mine], starts[first] + lo[mine], (starts[last] + lo[mine] + LENGTH) if len(rows) else starts]
    spans = pa.table([pa.array(x, pa.int64()).cast(t) for x, t in zip(spans, list(_FOUND.values())[:4])], names=list(_FOUND)[:4])
    for c in list(_FOUND)[4:]:
        spans = spans.append_column(c, pa.nulls(spans.num_rows, _FOUND[c]))
    handed = data.filter(pa.array(on))
    for c in ("start", "end"):
        handed = handed.append_column(c, pa.nulls(handed.num_rows, pa.int32()))
    return pa.concat_tables([spans, handed.select(list(_FOUND)).cast(spans.schema)])


def sort_bucket(batches):
    held = list(batches)
    data = pa.Table.from_batches(held) if held else None
    if data is not None and data.num_rows:
        yield from compare(data, False).to_batches(max_chunksize=4096)


def across_borders(data: pa.Table) -> pa.Table:
    return compare(data, True).select(["k1", "k2", "start", "end"])


# ---------------------------------------------------------------- removal
RESULT_DDL = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def remove(batches):
    for batch in batches:
        texts = batch.column(1)
        sizes, gone, spans, kept = [], [], [], []
        for i, found in enumerate(batch.column(2)):
            raw = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
            sizes.append(len(raw))
            runs: list[list[int]] = []
            if found.is_valid and len(found.values):
                s, e = (found.values.field(c).to_numpy().astype(np.int64) for c in (0, 1))
                by = np.argsort(s, kind="stable")
                s, e = s[by], np.maximum.accumulate(e[by])
                first = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
                runs = [[int(x), int(y)] for x, y in zip(s[first], e[np.append(first[1:], len(s)) - 1])]
            spans.append([{"start": x, "end": y} for x, y in runs])
            gone.append(sum(y - x for x, y in runs))
            edges = [0, *(x for run in runs for x in run), len(raw)]
            kept.append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2])) if runs else raw)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, _SPAN), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def dedup_substrings(docs: DataFrame, bucket_bytes: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of each document; spans are the maximal removed runs of bytes."""
    spark = docs.sparkSession
    ship(spark)
    key = ["k1", "k2"]
    texts = row_key(docs).select(*key, "doc_id", F.col("text").cast("binary").alias("text"))
    long = texts.filter(F.octet_length("text") >= LENGTH)
    anchors = materialize(long.select(*key, "text").mapInArrow(anchor_rows, ANCHORS), "anchors")
    # 1. classes of equal contexts, and the leads that several classes share
    one = F.min(F.struct(*key, "lo", "hi", "at")).alias("one")
    classes = materialize(anchors.groupBy("head", "class").agg(F.count(F.lit(1)).alias("n"), one), "classes")
    total = classes.count()
    leads = materialize(classes.groupBy("head").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").drop("least"), "leads")
    shared = enrich(classes, leads, ["head"], F.col("kinds") * 1000 >= F.lit(total), "inner")
    wanted = F.struct("one.lo", "one.hi", "one.at", "n", "head", (F.col("kinds") > CROWD).alias("crowded"))
    wanted = shared.groupBy("one.k1", "one.k2").agg(F.collect_list(wanted).alias("wanted"))  # of one text, so of its size
    single = long.select(*key, "text")
    if not long.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty():
        single = single.dropDuplicates(key)  # whole repeated rows give their contexts once
    contexts = materialize(single.join(wanted.hint("merge"), key).select(*key, "text", "wanted").mapInArrow(context_rows, CONTEXTS), "contexts")
    release(spark)
    # 2. buckets of sorted suffixes, 3. borders
    size, some = contexts.agg(F.coalesce(F.sum(F.octet_length("context")), F.lit(0)), F.count("window")).first()
    buckets = max(1, partitions(spark), -(-int(size) // (bucket_bytes or BUCKET_BYTES)))
    plain = contexts.filter("context is not null").drop("window", "start")
    ranged = plain.withColumn("suffix", F.expr(f"substring(context, pre + 1, {KEY})")).repartitionByRange(buckets, "suffix").drop("suffix")
    found = materialize(ranged.mapInArrow(sort_bucket, FOUND), "found")
    spans = found.filter("context is null").select(*key, "start", "end")
    borders = found.filter("context is not null").drop("start", "end").groupBy("head").applyInArrow(across_borders, SPANS)
    spans = spans.unionByName(borders)
    if some:
        crowd = contexts.filter("window is not null").select(*key, "window", "n", "start")
        twice = materialize(crowd.groupBy("window").agg(F.sum("n").alias("times")).filter("times > 1"), "windows")
        again = enrich(crowd, twice, ["window"], F.col("times") * 1000 >= F.lit(int(some)), "inner").filter("n = 1")
        spans = spans.unionByName(again.select(*key, "start", (F.col("start") + LENGTH).alias("end")))
    sure = classes.filter("n > 1").select("head", "class", "n")
    rows = anchors.count()
    copies = enrich(anchors, sure, ["head", "class"], F.col("n") * 1000 >= F.lit(rows), "inner")
    spans = spans.unionByName(copies.select(*key, F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("end")))
    by_text = materialize(spans.groupBy(*key).agg(F.collect_set(F.struct("start", "end")).alias("found")), "spans")
    discard(anchors, classes, leads, contexts, found)
    release(spark)
    every = texts.join(by_text.hint("merge"), key, "left")
    return every.select("doc_id", "text", "found").mapInArrow(remove, RESULT_DDL)
