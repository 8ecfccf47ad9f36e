"""Quality classifier by Bradley-Terry pairwise ranking over all training rows.

Each pair of a training document labelled good and one labelled bad says that the good one is preferred; the score of a
document is linear in indicators of its features' bins. Bins are quantiles of all training rows. The mean logistic loss on the
score differences of all pairs, with a ridge, is made least by L-BFGS. The threshold is the score quantile at the share of
bad documents among all training rows; scores are a logistic curve around it, so that 0.5 is the threshold. Features
are of bytes, words and lines of the whole text.

All pairs without listing them: within a cell of width 1 the logistic function is, to 11 digits, a polynomial of degree
NODES - 1 in the score, so that the rows of a class in a cell act as NODES weights at Chebyshev points. Each step gathers these weights
(one pass over the training rows), takes the loss and the slope in each node's score from pairs of nodes, and gathers the slope in
the bins (another pass). Passes read blocks of bin numbers; a block sends a few KB, and their sums run in the order of blocks.

Cases: null and empty texts have the features of an empty text and are scored; without training rows of both classes every
score is the share of good ones (0.5 without labels); empty tables give empty results; other columns are not read. Ties in
scores fall on the same side. Rows of equal features and label are one with a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import IS_SPACE, SLICE, Words, discard, fold_of, materialize, ship, slices, text_buffer
from folioscope.llm.labelled import known_labels

BINS = 24
RIDGE = 0.001
#: Steps at most, and the share of the first slope at which they end.
STEPS = 60
CLOSE = 1e-4
#: Earlier steps that L-BFGS knows.
MEMORY = 12
#: Distinct training rows of a block on average.
BLOCK_ROWS = 1 << 14

NODES = 10
NODE = np.cos((np.arange(NODES) + 0.5) * np.pi / NODES) / 2
_TO_NODES = np.linalg.inv(np.polynomial.chebyshev.chebvander(2 * NODE, NODES - 1))

_CODES = np.arange(256)
CLASSES = {
    "upper": (_CODES >= 65) & (_CODES <= 90),
    "lower": (_CODES >= 97) & (_CODES <= 122),
    "digit": (_CODES >= 48) & (_CODES <= 57),
    "wide": _CODES >= 128,
    "space": IS_SPACE,
    "line": _CODES == 10,
    "stop": np.isin(_CODES, [ord(c) for c in ".?!"]),
    "pause": np.isin(_CODES, [ord(c) for c in ",;:'\"-()"]),
    "mark": np.isin(_CODES, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]),
}

#: Features of a text: its size, shares of byte classes, and twelve numbers of its words.
WIDTH = 1 + len(CLASSES) + 12


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of WIDTH numbers for each text, of 12 significant bits, so that a corpus has few values of each."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)
    cols = [np.log1p(size)]
    for inside in CLASSES.values():
        total = np.concatenate([[0], np.cumsum(inside[buf], dtype=np.int64)])
        cols.append((total[offsets[1:]] - total[offsets[:-1]]) / some)
    w = Words(buf, offsets, True)
    words = np.diff(w.at).astype(float)
    many = np.maximum(words, 1)
    length = (w.end - w.start).astype(float)
    by = lambda x: np.bincount(w.doc, x, n)
    mean = by(length) / many
    cols += [np.log1p(words), mean, np.sqrt(np.maximum(by(length * length) / many - mean * mean, 0)), by((length <= 2).astype(float)) / many, by((length >= 16).astype(float)) / many]
    # how often words repeat: distinct ones, the most frequent one, and equal neighbours
    h = w.hashes()
    order = np.lexsort((h, w.doc))
    head = np.ones(len(h), bool)
    head[1:] = (h[order][1:] != h[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    at = np.flatnonzero(head)
    runs = np.diff(np.append(at, len(h))).astype(float)
    owner = w.doc[order][at]
    distinct = np.bincount(owner, minlength=n) / many
    top = np.zeros(n)
    np.maximum.at(top, owner, runs)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    last = buf[w.end - 1] if len(h) else buf[:0]
    first = buf[w.start] if len(h) else buf[:0]
    cols += [distinct * np.log1p(words), distinct, top / many, by(again) / many, by(CLASSES["mark"][last].astype(float)) / many, by(CLASSES["stop"][last].astype(float)) / many, by(CLASSES["upper"][first].astype(float)) / many]
    return (np.stack(cols, 1).astype(np.float32).view(np.uint32) & np.uint32(0xFFFFF000)).view(np.float32)


class Ranker:
    """Bin edges, a weight for each bin of each feature, and the place and width of the logistic curve; without edges, flat."""

    def __init__(self, flat: float, edges: list[np.ndarray] | None = None):
        self.flat, self.edges = flat, edges
        if edges is not None:
            self.begin = np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])])

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], 1).astype(np.uint8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return single(linear(self.bins(x), self.begin, self.weights))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.edges is None:
            return np.full(len(x), self.flat)
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.threshold) / self.width, -500, 500)))


def linear(bins: np.ndarray, begin: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return weights[bins + begin[:-1]].sum(1)


def single(scores: np.ndarray) -> np.ndarray:
    """Scores of 32 bits, as doubles: the threshold is sought among these."""
    return scores.astype(np.float32).astype(float)


# ---------------------------------------------------------------- features of a table
def feature_rows(column) -> np.ndarray:
    buf, offsets = text_buffer(column)
    rows = [features(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets, SLICE)]
    return np.concatenate(rows) if rows else np.zeros((0, WIDTH), np.float32)


def collect_features(batches):
    for batch in batches:
        x = [r.tobytes() for r in feature_rows(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["doc_id", "x"])


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of each document."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(collect_features, "doc_id long, x binary")


def matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, WIDTH)


# ---------------------------------------------------------------- passes over the training rows
def count_values(batches):
    """(feature, value, n) of each batch of (label, x, n)."""
    for batch in batches:
        x, n = matrix(batch.column(1)), batch.column(2).to_numpy()
        for j, c in enumerate(x.T):
            value, at = np.unique(c, return_inverse=True)
            many = np.bincount(at, n, len(value)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), j, np.int32)), pa.array(value), pa.array(many)], names=["feature", "value", "n"])


def bin_edges(rows: DataFrame, total: int) -> list[np.ndarray]:
    """Of each feature the least values that k / BINS of all training rows do not exceed, once each."""
    values = rows.mapInArrow(count_values, "feature int, value float, n long").groupBy("feature", "value").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("feature").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    cut = F.expr(f"least(upto * {BINS} div {total}, {BINS - 1}) > (upto - n) * {BINS} div {total}")
    found = values.withColumn("upto", upto).filter(cut).select("feature", "value").collect()
    return [np.array(sorted(r["value"] for r in found if r["feature"] == j), np.float32) for j in range(WIDTH)]


BLOCKS = "block int, label binary, n binary, bins binary"


def blocks_of(rows: DataFrame, ranker: Ranker, distinct: int) -> DataFrame:
    """Training rows as bin numbers, in blocks by a hash of the row, each in the order of label and features."""

    def pack(data: pa.Table) -> pa.Table:
        data = data.sort_by([("label", "ascending"), ("x", "ascending")])
        label, n = data.column("label").to_numpy().astype(np.uint8), data.column("n").to_numpy().astype(np.int64)
        cells = [data.column("block")[0].as_py(), label.tobytes(), n.tobytes(), ranker.bins(matrix(data.column("x"))).tobytes()]
        return pa.table([pa.array([c], t) for c, t in zip(cells, (pa.int32(), *[pa.binary()] * 3))], names=["block", "label", "n", "bins"])

    block = F.pmod(F.xxhash64("label", "x"), F.lit(-(-distinct // BLOCK_ROWS))).cast("int")
    return rows.withColumn("block", block).groupBy("block").applyInArrow(pack, BLOCKS)


def basis(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each score, and its share in the cell's nodes."""
    cell = np.floor(scores)
    return cell.astype(np.int64), np.polynomial.chebyshev.chebvander(2 * (scores - cell - 0.5), NODES - 1) @ _TO_NODES


class Pairs:
    """The mean loss of all pairs, its slope, and the quantile of scores, by passes over the blocks."""

    def __init__(self, blocks: DataFrame, ranker: Ranker, bad: int, good: int):
        self.blocks, self.begin, self.many = blocks, ranker.begin, (bad, good)
        self.scale = 50 / 60_000 + sum(s / m for s, m in zip(self.in_bins(None, None), self.many))

    def gather(self, run) -> list[tuple]:
        """(label, key, numbers) that run yields for the bins, counts and label of each class of each block, in the order of blocks."""

        def read(batches):
            for batch in batches:
                for block, label, n, bins in zip(*(c.to_pylist() for c in batch.columns)):
                    label, n = np.frombuffer(label, np.uint8), np.frombuffer(n, np.int64)
                    bins = np.frombuffer(bins, np.uint8).reshape(-1, WIDTH)
                    rows = [(block, k, key, x.tobytes()) for k in (0, 1) if (label == k).any() for key, x in run(bins[label == k], n[label == k], k)]
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["block", "label", "key", "data"])

        return [tuple(r)[1:] for r in sorted(self.blocks.mapInArrow(read, "block int, label int, key long, data binary").collect(), key=lambda r: tuple(r)[:3])]

    def nodes(self, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(place, weight) of the nodes of each class, by cell."""
        begin = self.begin

        def run(bins, n, _):
            cell, share = basis(linear(bins, begin, weights))
            own, at = np.unique(cell, return_inverse=True)
            total = np.stack([np.bincount(at, n * s, len(own)) for s in share.T], 1)
            return zip(own.tolist(), total)

        sums: list[dict] = [{}, {}]
        for label, cell, data in self.gather(run):
            sums[label][cell] = sums[label].get(cell, 0) + np.frombuffer(data)
        return [(np.array(sorted(s))[:, None] + 0.5 + NODE, np.stack([s[c] for c in sorted(s)])) for s in sums]

    def in_bins(self, weights: np.ndarray | None, pull: list | None) -> list[np.ndarray]:
        """Of each class, the sum over its rows in each bin; of pull, given at nodes as (cells, values), or else of 1."""
        begin = self.begin

        def run(bins, n, label):
            each = n.astype(float)
            if weights is not None:
                cell, share = basis(linear(bins, begin, weights))
                own, value = pull[label]
                each *= (share * value[np.searchsorted(own, cell)]).sum(1)
            return [(0, np.bincount((bins + begin[:-1]).ravel(), np.repeat(each, WIDTH), begin[-1]))]

        sums = [np.zeros(begin[-1]), np.zeros(begin[-1])]
        for label, _, data in self.gather(run):
            sums[label] += np.frombuffer(data)
        return sums

    def loss(self, weights: np.ndarray) -> tuple[float, list]:
        """The loss, and the slope in the score of each class at its nodes."""
        (low, bad), (high, good) = self.nodes(weights)
        gap = low.ravel() - high.ravel()[:, None]
        bad, good = bad / self.many[0], good / self.many[1]
        value = good.ravel() @ np.logaddexp(0, gap) @ bad.ravel() + RIDGE * (self.scale * weights * weights).sum()
        wrong = 1 / (1 + np.exp(-np.clip(gap, -500, 500)))  # of preferring the bad one
        cells = [np.floor(x[:, 0]).astype(np.int64) for x in (low, high)]
        return float(value), [(cells[0], (good.ravel() @ wrong).reshape(bad.shape)), (cells[1], (wrong @ bad.ravel()).reshape(good.shape))]

    def slope(self, weights: np.ndarray, pull: list) -> np.ndarray:
        bad, good = self.in_bins(weights, pull)
        return bad / self.many[0] - good / self.many[1] + 2 * RIDGE * self.scale * weights

    def ranked(self, weights: np.ndarray, ranks: list[int]) -> list[float]:
        """The 32-bit scores that stand at these places, from 0, in the order of all; by digits from the highest."""
        begin, rest, found = self.begin, list(ranks), [0] * len(ranks)
        for shift, width in ((21, 11), (10, 11), (0, 10)):
            prefix = list(found)

            def run(bins, n, _, shift=shift, width=width, prefix=prefix):
                bits = single(linear(bins, begin, weights)).astype(np.float32).view(np.uint32).astype(np.int64)
                key = np.where(bits >> 31, bits ^ 0xFFFFFFFF, bits | 1 << 31) >> shift
                for i, p in enumerate(prefix):
                    here = key >> width == p
                    yield i, np.bincount(key[here] & (1 << width) - 1, n[here], 1 << width)

            counts = np.zeros((len(ranks), 1 << width))
            for _, i, data in self.gather(run):
                counts[i] += np.frombuffer(data)
            for i, c in enumerate(counts):
                digit = int(np.searchsorted(np.cumsum(c), rest[i], "right"))
                rest[i] -= int(c[:digit].sum())
                found[i] = prefix[i] << width | digit
        bits = np.array([k ^ 1 << 31 if k >> 31 else k ^ 0xFFFFFFFF for k in found], np.uint32)
        return bits.view(np.float32).astype(float).tolist()


def least_loss(pairs: Pairs) -> np.ndarray:
    """L-BFGS from zero, scaled by how often each bin occurs; a step is halved until the loss falls enough."""
    w = np.zeros(len(pairs.scale))
    value, pull = pairs.loss(w)
    g = pairs.slope(w, pull)
    size = lambda g: float(np.sqrt((g * g / pairs.scale).sum()))
    first, known = size(g), []
    for _ in range(STEPS):
        if size(g) <= max(CLOSE * first, 1e-9):  # no more than rounding
            break
        move, taken = g.copy(), []
        for s, y in reversed(known):
            taken.append((s @ move) / (s @ y))
            move -= taken[-1] * y
        move *= (known[-1][0] @ known[-1][1] / (known[-1][1] ** 2 / pairs.scale).sum() if known else 2) / pairs.scale
        for (s, y), t in zip(known, reversed(taken)):
            move += (t - (y @ move) / (s @ y)) * s
        step = 1.0
        while True:
            to = w - step * move
            now, pull = pairs.loss(to)
            if now <= value - 1e-4 * step * (g @ move):
                break
            step /= 2
            if step < 1e-6:  # no further in doubles
                return w
        after = pairs.slope(to, pull)
        if (to - w) @ (after - g) > 0:
            known = [*known, (to - w, after - g)][-MEMORY:]
        w, value, g = to, now, after
    return w


# ---------------------------------------------------------------- training and scoring
def fit(rows: DataFrame, labels: DataFrame, is_training: Column) -> Ranker:
    """Learned from every row of (doc_id, x) that has a training label; is_training is over __id."""
    known = known_labels(labels, "quality", is_training).filter("__label in (0, 1)")
    own = rows.join(known.hint("merge"), rows["doc_id"] == known["__id"]).groupBy(F.col("__label").alias("label"), "x").agg(F.count(F.lit(1)).alias("n"))
    own = materialize(own, "training")
    found = {r["label"]: r for r in own.groupBy("label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")).collect()}
    bad, good = (int(found[k]["n"]) if k in found else 0 for k in (0, 1))
    if not bad or not good:
        discard(own)
        return Ranker(good / (bad + good) if bad + good else 0.5)
    ranker = Ranker(good / (bad + good), bin_edges(own, bad + good))
    blocks = materialize(blocks_of(own, ranker, sum(r["distinct"] for r in found.values())), "blocks")
    pairs = Pairs(blocks, ranker, bad, good)
    ranker.weights = least_loss(pairs)
    ranker.threshold = sum(pairs.ranked(ranker.weights, [bad - 1, bad])) / 2
    place, weight = (np.concatenate([x.ravel() for x in both]) for both in zip(*pairs.nodes(ranker.weights)))
    mean = place @ weight / weight.sum()
    ranker.width = max(float(np.sqrt(max((place - mean) ** 2 @ weight / weight.sum(), 0))), 1e-6) / 4
    discard(own, blocks)
    return ranker


def train(docs: DataFrame, labels: DataFrame, is_training: Column) -> Ranker:
    """fit on documents."""
    rows = materialize(feature_table(docs), "features")
    ranker = fit(rows, labels, is_training)
    discard(rows)
    return ranker


def score_rows(rows: DataFrame, ranker: Ranker) -> DataFrame:
    """(doc_id, score) of each row of (doc_id, x)."""
    model = rows.sparkSession.sparkContext.broadcast(ranker)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(matrix(batch.column(1))), pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def score_documents(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """(doc_id, score) of each document."""
    return score_rows(feature_table(docs), ranker)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted); rows whose fold of three is 1 are held out."""
    held = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    rows = materialize(feature_table(docs), "features")
    ranker = fit(rows, labels, fold_of(F.col("__id"), 3) != 1)
    return score_rows(rows, ranker).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
