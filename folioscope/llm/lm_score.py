"""LM scoring by deleted interpolation of n-gram estimates.

The model of order two mixes the maximum-likelihood estimate of a word after the word before it with a smoothed estimate of
the word alone: p = l * c(h, w) / c(h) + (1 - l) * (c(w) + 0.1) / (N + 0.1 * (V + 1)). The weight l depends on
the bucket of c(h), by powers of two, and is learned by expectation-maximisation on counts of a held-out tenth of the
training documents against the counts of the rest; then counts of all training documents are used. A text opens after a
fixed start and ends with an end token.

Counts are gathered from all training documents. Documents lie in blocks by a hash of id and text; a block sends each part of the
hash space its distinct keys with counts, once, and gets the corpus counts of these keys back, so a word that is everywhere is one
key a block. The driver sees sums, and a histogram of bounded size for the mixture weights.

Cases: null and empty texts are the end token alone; a null doc_id is a training row; with no training rows the estimate of a
word alone is uniform over one word; a repeated row counts and is scored each time; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import BASE, LOOKUP, block_words, expand, fold_of, from_planes, grow, in_blocks, materialize, mix, part_of, planes, release, ship, shrink, squeeze, table

BLOCK_BYTES, PART_BYTES = 6 << 20, 6 << 20
ADDED = 0.1
FOLDS, OUT, DEV = 10, 0, 1
BUCKETS = 26
#: Likelihood ratios are kept to a sixteenth of a power of two.
GRAIN, SPAN = 16, 48
START, END = np.uint64(0x5D1E9F2A77C3B490), np.uint64(0x3C6EF372FE94F82B)
ONE = np.uint64(1)


def fold(doc_id) -> int:
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


def token_keys(texts, doc_ids):
    """Keys of tokens (odd) and of pairs (even), the key of what stands before each token, and each token's text and fold."""
    h, doc, at = block_words(texts, True)
    n = len(at) - 1
    total = len(h) + n
    own = np.empty(total, np.uint64)
    place = np.arange(len(h)) + doc
    ends = at[1:] + np.arange(n)
    own[place] = h | ONE
    own[ends] = END | ONE
    before = np.empty(total, np.uint64)
    before[1:] = own[:-1]
    before[at[:-1] + np.arange(n)] = START & ~ONE
    pair = mix(before * BASE + own) & ~ONE
    owner = np.empty(total, np.int64)
    owner[place] = doc
    owner[ends] = np.arange(n)
    folds = np.array([fold(d) for d in doc_ids], np.int64)
    return own, pair, before, owner, folds


def ask(parts: int):
    def run(docs: pa.Table) -> pa.Table:
        block = docs.column("block")[0].as_py()
        own, pair, _, owner, folds = token_keys(docs.column("text"), docs.column("doc_id").to_pylist())
        of = folds[owner]
        starts = np.full(len(folds), START & ~ONE)
        keys = np.concatenate([own, pair, starts])
        every = np.concatenate([of, of, folds])
        distinct = np.unique(keys)
        count = lambda chosen: np.bincount(np.searchsorted(distinct, keys[chosen]), minlength=len(distinct)).astype(np.uint32)
        core, dev = count((every != OUT) & (every != DEV)), count(every == DEV)
        part = part_of(distinct, parts)
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
        rows = [(int(part[a]), block, 0, squeeze(distinct[a:b]) + shrink(planes(core[a:b]) + planes(dev[a:b])) + np.uint32(b - a).tobytes()) for a, b in zip(edges[:-1], edges[1:]) if b > a]
        asked = np.unique(keys[every == DEV])
        part = part_of(asked, parts)
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
        return table(rows + [(int(part[a]), block, 1, squeeze(asked[a:b])) for a, b in zip(edges[:-1], edges[1:]) if b > a])

    return run


def answer(data: pa.Table) -> pa.Table:
    """Corpus counts (core, and all training) of each block's keys; kind 2: tokens and distinct tokens of core and of all."""
    rows = list(zip(*[data.column(c).to_pylist() for c in ("part", "block", "kind", "data")]))
    keys, core, every = [], [], []
    for _, _, kind, d in rows:
        if kind == 0:
            n = int(np.frombuffer(d[-4:], np.uint32)[0])
            keys.append(expand(d[: 8 * n]))
            counts = grow(d[8 * n : -4])
            core.append(from_planes(counts[: 4 * n], np.uint32))
            every.append(from_planes(counts[4 * n :], np.uint32))
    distinct = np.unique(np.concatenate(keys))
    total, whole = np.zeros(len(distinct), np.uint64), np.zeros(len(distinct), np.uint64)
    for k, c, d in zip(keys, core, every):  # the keys of one block are distinct
        at = np.searchsorted(distinct, k)
        total[at] += c
        whole[at] += d
    core, every = total, total + whole
    out = []
    it = iter(keys)
    for p, b, kind, d in rows:
        mine = next(it) if kind == 0 else expand(d)
        at = np.searchsorted(distinct, mine)
        out.append((p, b, kind, shrink(planes(core[at]) + planes(every[at]))))
    token = (distinct & ONE) == ONE
    sums = np.array([core[token].sum(), (core[token] > 0).sum(), every[token].sum(), (every[token] > 0).sum()], np.uint64)
    return table([*out, (rows[0][0], -1, 2, sums.tobytes())])


def answers(table_: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Core and full counts of a block's sorted keys."""
    got = sorted((p, grow(d)) for p, k, d in zip(*[table_.column(c).to_pylist() for c in ("part", "kind", "data")]) if k == kind)
    half = [len(d) // 2 for _, d in got]
    join = lambda x: np.concatenate(x).astype(float) if x else np.zeros(0)
    return join([from_planes(d[:n], np.uint64) for (_, d), n in zip(got, half)]), join([from_planes(d[n:], np.uint64) for (_, d), n in zip(got, half)])


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the power of two below its count."""
    return np.minimum(np.floor(np.log2(np.maximum(context, 0.5))).astype(int) + 1, BUCKETS - 1)


def estimates(own, pair, before, distinct, counts, tokens: float, words: float):
    """Of each token: its count, the count of what stands before it, its pair's estimate and its own."""
    find = lambda k: counts[np.searchsorted(distinct, k)]
    alone, context, both = find(own), find(before), find(pair)
    single = (alone + ADDED) / (tokens + ADDED * (words + 1))
    return alone, context, np.where(context > 0, both / np.maximum(context, 1), 0.0), single


def held_out_ratios(sums):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.int64())], names=["bucket", "bin", "n"])
        if not docs.num_rows:
            return none
        own, pair, before, _, folds = token_keys(docs.column("text"), docs.column("doc_id").to_pylist())
        distinct = np.unique(np.concatenate([own, pair, np.full(len(folds), START & ~ONE)]))
        _, context, ml, single = estimates(own, pair, before, distinct, answers(replies, 1)[0], sums[0], sums[1])
        seen = context > 0
        ratio = np.full(int(seen.sum()), -1.0)
        r = ml[seen] / single[seen]
        bins = np.where(r > 0, np.clip(np.round(np.log2(np.maximum(r, 1e-300)) * GRAIN), -SPAN * GRAIN, SPAN * GRAIN) + SPAN * GRAIN + 1, 0).astype(np.int64)
        code, n = np.unique(bucket_of(context[seen]) * 100_000 + bins, return_counts=True)
        return pa.table([pa.array(code // 100_000, pa.int32()), pa.array(code % 100_000, pa.int32()), pa.array(n, pa.int64())], names=["bucket", "bin", "n"]) if len(ratio) else none

    return run


def mixture_weights(rows, steps: int = 200) -> np.ndarray:
    """For each bucket the weight of the pair's estimate, by expectation-maximisation over the histogram of ratios."""
    weights = np.zeros(BUCKETS)
    for b in range(1, BUCKETS):
        mine = [(r["bin"], r["n"]) for r in rows if r["bucket"] == b]
        if not mine:
            weights[b] = weights[b - 1]
            continue
        bins, n = np.array(mine, float).T
        r = np.where(bins > 0, 2.0 ** ((bins - 1) / GRAIN - SPAN), 0.0)
        w = 0.5
        for _ in range(steps):
            w = float((n * (w * r / (w * r + 1 - w))).sum() / n.sum())
        weights[b] = min(max(w, 0.0), 1 - 1e-6)
    return weights


SCORES = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_block(sums, weights: np.ndarray):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({k: pa.array([], t) for k, t in SCORES.items()})
        own, pair, before, owner, folds = token_keys(docs.column("text"), docs.column("doc_id").to_pylist())
        distinct = np.unique(np.concatenate([own, pair, np.full(len(folds), START & ~ONE)]))
        alone, context, ml, single = estimates(own, pair, before, distinct, answers(replies, 0)[1], sums[2], sums[3])
        w = weights[bucket_of(context)]
        n = len(folds)
        by = lambda x: np.bincount(owner, x, n)
        cols = [docs.column("doc_id").cast(pa.int64()), pa.array(folds == OUT), pa.array(np.bincount(owner, minlength=n), pa.int64()), pa.array(by((alone > 0).astype(float)).astype(np.int64)), pa.array(np.full(n, int(sums[2])), pa.int64()), pa.array(by(np.log10(single))), pa.array(by(np.log10(w * ml + (1 - w) * single)))]
        return pa.table(cols, names=list(SCORES))

    return run


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document."""
    spark = docs.sparkSession
    ship(spark)
    blocked, parts = in_blocks(docs, block_bytes, part_bytes)
    replies = materialize(blocked.groupBy("block").applyInArrow(ask(parts), LOOKUP).groupBy("part").applyInArrow(answer, LOOKUP), "counts")
    release(spark)
    sums = [0.0] * 4
    for row in replies.filter("kind = 2").select("data").collect():
        sums = [a + float(b) for a, b in zip(sums, np.frombuffer(row["data"], np.uint64))]
    dev = blocked.filter(fold_of(F.col("doc_id"), FOLDS) == DEV)
    ratios = dev.groupBy("block").cogroup(replies.filter("kind = 1").groupBy("block")).applyInArrow(held_out_ratios(sums), "bucket int, bin int, n long")
    weights = mixture_weights(ratios.groupBy("bucket", "bin").agg(F.sum("n").alias("n")).collect())
    return blocked.groupBy("block").cogroup(replies.filter("kind = 0").groupBy("block")).applyInArrow(score_block(sums, weights), SCORES_DDL)
