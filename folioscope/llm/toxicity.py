"""Toxicity by a linear-chain conditional random field.

Tokens of labelled documents are tagged from what the document labels show: words, and openings of words, that are far
more frequent in toxic training documents than in clean ones (likelihood ratio) make toxic tokens where they stand in a toxic
document. A two-state chain with weights for the word, its openings of 4 to 8 bytes and the word before it is trained on
those tags by adaptive gradient steps on the exact conditional likelihood. A document's score is a logistic curve, fitted on
training documents, over its marginals by forward-backward: the largest one, the expected number of toxic words, and that
number against the text's length. Tokens with a marginal of a half or more give the offending byte spans.

Chains run along CHAIN words; longer texts are several chains, all scored. Cases: null and empty texts have no token and
score as the curve's floor; without training rows of both classes every score is the share of toxic ones (0 without labels); empty
tables give empty results; other columns are not read. The field is trained in one executor task, on a labelled sample bounded by
SAMPLE rows of each class and LONGEST bytes a text; the driver holds the weights that are not zero.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import SLICE, Words, fold_of, mix, powers, prefix_hash, ship, slices, text_buffer, tidied, tidy
from folioscope.llm.labelled import labelled_sample

SAMPLE, LONGEST = 3000, 1 << 16
CHAIN = 64
BUCKETS = 1 << 20
OPENINGS = (4, 5, 6, 7, 8)
EPOCHS = 6
FLOOR = -30.0
#: A word or opening marks toxic texts if its likelihood ratio is at least RATIO and this share of the best one's, and its
#: frequency among toxic texts is so much of the sum of those among toxic and among clean ones.
RATIO, RATIO_SHARE, PRECISION = 25.0, 0.03, 0.8

#: Other ASCII characters part words here; spans still count in the text's own bytes.
LETTERS = np.array([c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)


def word_keys(buf: np.ndarray, offsets: np.ndarray):
    """Runs of letters and digits, lower-cased: 32-bit hashes of each word and its openings, text number, first word of each text, byte spans."""
    w = Words(LETTERS[buf], offsets, True)
    p = prefix_hash(w.buf)
    _, down = powers(len(w.buf) + 1)
    hashes = [w.hashes()]
    for k in OPENINGS:
        hashes.append(mix((p[np.minimum(w.start + k, w.end)] - p[w.start]) * down[w.start] + np.uint64(k << 40)))
    return np.stack([(h >> np.uint64(32)).astype(np.uint32) for h in hashes], 1), w.doc, w.at, w.start, w.end


def emission_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The buckets of each word and its openings, and of the word before it (a fixed one at the start)."""
    own = (h & np.uint32(BUCKETS - 1)).astype(np.int32)
    before = np.empty(len(own), np.int32)
    before[1:] = own[:-1, 0] ^ 0x55555
    before[first] = BUCKETS - 1
    return np.concatenate([own, before[:, None]], 1)


def chains(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the chains of all texts; at: where each text's words begin."""
    n = np.diff(at)
    per = -(-n // CHAIN)
    doc = np.repeat(np.arange(len(n)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = at[doc] + nth * CHAIN
    return start, np.minimum(n[doc] - nth * CHAIN, CHAIN)


class Field:
    """Weights of buckets and of no bucket (bias), the four transitions, and the curve; state 1 is toxic."""

    def __init__(self):
        self.weight = np.zeros(BUCKETS, np.float32)
        self.bias = -4.0
        self.move = np.zeros((2, 2))
        self.curve = np.array([1.0, 0.0, 0.0, 0.0])
        self.flat: float | None = None

    def __getstate__(self) -> dict:
        """The weights that are not zero, as places and values."""
        some = np.flatnonzero(self.weight).astype(np.int32)
        return self.__dict__ | {"weight": (some, self.weight[some])}

    def __setstate__(self, state: dict) -> None:
        some, values = state["weight"]
        weight = np.zeros(BUCKETS, np.float32)
        weight[some] = values
        self.__dict__.update(state | {"weight": weight})

    def emissions(self, keys: np.ndarray) -> np.ndarray:
        total = np.full(keys.shape[:-1], self.bias)
        for column in np.moveaxis(keys, -1, 0):
            total += self.weight[column]
        return np.clip(total, -60, 60)

    def messages(self, e: np.ndarray, mask: np.ndarray):
        """Forward and backward ratios of toxic to clean, for chains as rows."""
        t = np.exp(self.move)
        x = np.exp(e)
        n, m = e.shape
        f, b = np.ones((m, n)), np.ones((m, n))
        x, mask = np.ascontiguousarray(x.T), np.ascontiguousarray(mask.T)
        f[0] = x[0]
        for i in range(1, m):
            f[i] = x[i] * (f[i - 1] * t[1, 1] + t[0, 1]) / (f[i - 1] * t[1, 0] + t[0, 0])
        for i in range(m - 2, -1, -1):
            y = x[i + 1] * b[i + 1]
            b[i] = np.where(mask[i + 1], (t[1, 1] * y + t[1, 0]) / (t[0, 1] * y + t[0, 0]), 1.0)
        return f.T, b.T

    def logits(self, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log odds of each word's marginal."""
        e = self.emissions(keys)
        out = np.empty(len(e))
        start, length = chains(at)
        for a in range(0, len(start), 4096):
            s, k = start[a : a + 4096], length[a : a + 4096]
            m = int(k.max())
            place = s[:, None] + np.arange(m)
            mask = np.arange(m) < k[:, None]
            f, b = self.messages(np.where(mask, e[np.minimum(place, len(e) - 1)], 0.0), mask)
            out[place[mask]] = np.log(f[mask]) + np.log(b[mask])
        return out

    def fit(self, keys: np.ndarray, at: np.ndarray, tags: np.ndarray, seed: int = 3) -> None:
        start, length = chains(at)
        rng = np.random.default_rng(seed)
        sums = [np.full(BUCKETS, 1e-2, np.float32), 1e-2, np.full((2, 2), 1e-2)]
        gradient = np.zeros(BUCKETS, np.float32)
        for _ in range(EPOCHS):
            order = rng.permutation(len(start))
            for a in range(0, len(order), 2048):
                s, k = start[order[a : a + 2048]], length[order[a : a + 2048]]
                m = int(k.max())
                mask = np.arange(m) < k[:, None]
                place = np.minimum(s[:, None] + np.arange(m), len(keys) - 1)
                e = np.zeros(mask.shape)
                own = keys[place[mask]]
                e[mask] = self.emissions(own)
                f, b = self.messages(e, mask)
                p = np.where(mask, f * b / (1 + f * b), 0.0)
                y = np.where(mask, tags[place], 0.0)
                g = (y - p)[mask]
                both = mask[:, 1:]
                t = np.exp(self.move)
                xb = np.exp(e[:, 1:]) * b[:, 1:]
                joint = np.stack([np.full_like(xb, t[0, 0]), t[0, 1] * xb, t[1, 0] * f[:, :-1], t[1, 1] * f[:, :-1] * xb])
                joint = (joint / joint.sum(0))[:, both].sum(1).reshape(2, 2)
                y0, y1 = y[:, :-1][both], y[:, 1:][both]
                seen = np.array([[((1 - y0) * (1 - y1)).sum(), ((1 - y0) * y1).sum()], [(y0 * (1 - y1)).sum(), (y0 * y1).sum()]])
                for column in own.T:
                    np.add.at(gradient, column, g.astype(np.float32))
                some = np.flatnonzero(gradient)  # only weights of this batch's buckets move
                grad = gradient[some] - np.float32(0.02) * self.weight[some]
                gradient[some] = 0
                sums[0][some] += grad * grad
                self.weight[some] += np.float32(0.3) * grad / np.sqrt(sums[0][some])
                for i, what, grad, rate in ((1, "bias", g.sum(), 0.1), (2, "move", seen - joint, 0.05)):
                    w = getattr(self, what)
                    grad = grad - 0.02 * w * (np.abs(grad) > 0)
                    sums[i] = sums[i] + grad * grad
                    setattr(self, what, w + rate * grad / np.sqrt(sums[i]))

    def fit_curve(self, x: np.ndarray, y: np.ndarray, share: float) -> None:
        """A logistic curve over the summary of a document; classes weigh as among all training rows."""
        weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
        x = np.concatenate([x, np.ones((len(x), 1))], 1)
        w = np.zeros(x.shape[1])
        hold = np.diag([1e-5] * (x.shape[1] - 1) + [1e-7])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            v = weight * np.maximum(p * (1 - p), 1e-7)
            step = np.linalg.solve(x.T @ (v[:, None] * x) + hold, x.T @ (weight * (y - p)) - hold @ w)
            w += step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        self.curve = w

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -500, 500)))


def summary(z: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text: the largest log odds, and the expected toxic words plain and against length; and the expected words alone."""
    n = len(at) - 1
    expected = np.bincount(doc, 1 / (1 + np.exp(-np.clip(z, -500, 500))), n)
    words = np.diff(at)
    return np.stack([largest(z, at) / 5, np.log1p(expected), np.log1p(10 * expected / np.sqrt(words + 1))], 1), expected


def largest(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.full(len(at) - 1, FLOOR)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = np.maximum(np.maximum.reduceat(logits, at[some]), FLOOR)
    return out


def marks(h: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which words (or openings, given as hashes) mark toxic documents, by the likelihood ratio of document frequencies."""
    _, once = np.unique(h.astype(np.uint64) | doc.astype(np.uint64) << np.uint64(32), return_index=True)
    words, where = np.unique(h[once], return_inverse=True)
    bad = y[doc[once]] == 1
    k1, k0 = np.bincount(where, bad, len(words)), np.bincount(where, ~bad, len(words))
    n1, n0 = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    total = k1 + k0
    part = total * n1 / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(k1 > 0, k1 * np.log(k1 / part), 0) + np.where(k0 > 0, k0 * np.log(k0 / (total - part)), 0))
    ratio[(k1 / n1) / (k1 / n1 + k0 / n0) < PRECISION] = 0
    return words[(ratio >= RATIO) & (ratio >= RATIO_SHARE * ratio.max())] if len(words) else words


def toxic_tags(h: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    tags = np.zeros(len(h), bool)
    for column in h.T:
        tags |= np.isin(column, marks(column, doc, y))
    return tags & (y[doc] == 1)


def collect_words(batches):
    for batch in batches:
        buf, offsets = text_buffer(batch.column(1))
        out = []
        for a, b in slices(offsets, SLICE):
            h, _, at, *_ = word_keys(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out += [np.ascontiguousarray(h[at[i] : at[i + 1]]).tobytes() for i in range(b - a)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["doc_id", "label", "words"])


def train(docs: DataFrame, labels: DataFrame, is_training: Column, sample: int = SAMPLE) -> Field:
    """is_training is over __id. The sample meets in one executor task, which fits the field; its weights come back."""
    ship(docs.sparkSession)
    shares = {r["q"]: r["n"] for r in labels.withColumn("__id", F.col("doc_id").cast("long")).filter(is_training & F.col("toxic").isin(0, 1)).groupBy(F.col("toxic").alias("q")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(shares.values())
    share = shares.get(1, 0) / total if total else 0.0

    def fit(data: pa.Table) -> pa.Table:
        data = data.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("words", "ascending")])
        y = data.column("label").to_numpy().astype(int)
        each = [np.frombuffer(w.as_buffer(), np.uint32).reshape(-1, 1 + len(OPENINGS)) for w in data.column("words")]
        found = pickle.dumps(fitted(each, y, share))
        del data, each
        tidy()
        return pa.table({"field": pa.array([found], pa.binary())})

    rows = labelled_sample(docs, labels, "toxic", is_training, sample, LONGEST).mapInArrow(tidied(collect_words), "doc_id long, label int, words binary")
    found = rows.withColumn("all", F.lit(True)).groupBy("all").applyInArrow(fit, "field binary").collect()
    return pickle.loads(bytes(found[0]["field"])) if found else fitted([], np.zeros(0, int), share)


def fitted(each: list[np.ndarray], y: np.ndarray, share: float) -> Field:
    field = Field()
    if not (y == 1).any() or not (y == 0).any():
        field.flat = share
        return field
    at = np.concatenate([[0], np.cumsum([len(x) for x in each])])
    h = np.concatenate(each)
    doc = np.repeat(np.arange(len(y)), np.diff(at))
    tags = toxic_tags(h, doc, y)
    keys = emission_keys(h, at[:-1][np.diff(at) > 0])
    field.fit(keys, at, tags.astype(float))
    field.fit_curve(summary(field.logits(keys, at), doc, at)[0], y, share)
    return field


SCORED = "doc_id long, score double, toxic_words double, spans array<struct<start:long,end:long>>"


def score_documents(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, score, toxic_words expected, spans): spans are byte offsets in the text of runs of toxic words."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            scores, expected, spans = [], [], []
            for a, b in slices(offsets, SLICE):
                here = offsets[a : b + 1] - offsets[a]
                h, doc, at, start, end = word_keys(buf[offsets[a] : offsets[b]], here)
                z = model.value.logits(emission_keys(h, at[:-1][np.diff(at) > 0]), at)
                x, toxic = summary(z, doc, at)
                scores.append(model.value.score(x))
                expected.append(toxic)
                found: list[list] = [[] for _ in range(b - a)]
                last = -2
                for i in np.flatnonzero(z >= 0).tolist():
                    mine = found[doc[i]]
                    if i == last + 1 and mine:
                        mine[-1]["end"] = int(end[i] - here[doc[i]])
                    else:
                        mine.append({"start": int(start[i] - here[doc[i]]), "end": int(end[i] - here[doc[i]])})
                    last = i
                spans += found
            join = lambda x: np.concatenate(x) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(join(scores), pa.float64()), pa.array(join(expected), pa.float64()), pa.array(spans, span)], names=["doc_id", "score", "toxic_words", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), SCORED)


def is_training(doc_id: Column) -> Column:
    return fold_of(doc_id, 5) != 0


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted); rows whose fold of five is 0 are held out."""
    field = train(docs, labels, is_training(F.col("__id")))
    held = F.coalesce(~is_training(F.col("doc_id")), F.lit(False))
    return score_documents(docs, field).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_words", "spans")


def keep_clean(docs: DataFrame, field: Field) -> DataFrame:
    """The documents that score below a half, with all their columns; no row is moved."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(field)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            buf, offsets = text_buffer(batch.column(place))
            keep = []
            for a, b in slices(offsets, SLICE):
                h, doc, at, *_ = word_keys(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                z = model.value.logits(emission_keys(h, at[:-1][np.diff(at) > 0]), at)
                keep.append(model.value.score(summary(z, doc, at)[0]) < 0.5)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(tidied(run), docs.schema)
