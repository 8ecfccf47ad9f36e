"""Packing documents into token windows by non-negative least squares.

A document is its token ids and an end id. Whole windows are cut from its front; the tail, shorter than a window, is
placed among other tails. The histogram of tail lengths (at most 2048 numbers) is all that the driver sees: it
enumerates shallow combinations of lengths that fill a window, finds how often to repeat each by non-negative least
squares against the histogram, rounds down, packs what is left greedily by nearly full combinations, and lays the
rest end to end, cut at window borders. A tail finds its place from its length and its rank among tails of that length;
ranks are prefix sums of counts by (length, task), so no key gathers rows and no document is sorted or moved.

Tokens: text is cut before each single space between other characters, where byte-level BPE always cuts, and each distinct
piece of a run of texts is encoded once; texts with other white space beside a space are encoded whole.

Cases: null and empty texts are the end id alone; a repeated doc_id is a document of its own; an empty table gives no
pieces; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import materialize, ship, slices, tidied, tidy

WINDOW = 2048
END_ID = 1
#: Most padding of a greedy combination, in tokens.
SLACK = 8
SLICE_BYTES = 3 << 20
UNSAFE = re.compile(r"\s[ ]|[ ]\s|[ ]\Z|\A[ ]|\A\Z")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- tokens
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """The ids of a byte-level BPE file of the tokenizers library, without special tokens added."""

    #: Fixed value: the pattern by which that pre-tokenizer cuts.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in word): n for word, n in spec["model"]["vocab"].items() if word not in special}
        self.fast = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self._slow = path, None
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.opens = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self.opens[[n for word, n in ranks.items() if word[:1] == b" "]] = True

    @property
    def slow(self):
        """The library's own encoder, for texts that hold special tokens; most workers never load it."""
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    @classmethod
    def at(cls, path: str) -> "Encoder":
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def one(self, text: str) -> np.ndarray:
        if self.special and self.special.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        easy = []
        for i, t in enumerate(texts):
            if UNSAFE.search(t) or self.special and self.special.search(t):
                out[i] = self.one(t)
            else:
                easy.append(i)
        if not easy:
            return out
        pieces = pc.split_pattern(pa.array([texts[i] for i in easy], pa.large_string()), " ")
        at = pieces.offsets.to_numpy()
        coded = pieces.flatten().dictionary_encode()
        which = coded.indices.to_numpy()
        words = coded.dictionary.to_pylist()
        # every distinct piece after a space, encoded in one go; a token that opens with a space begins a piece
        flat = np.array(self.fast.encode_ordinary(" " + " ".join(words)), np.uint32)
        begin = np.flatnonzero(self.opens[flat])
        length = np.diff(np.append(begin, len(flat)))
        lens = length[which]
        lens[at[:-1]] = 0  # what opens a text has no space before it
        to = np.cumsum(lens)
        ids = flat[np.repeat(begin[which] - (to - lens), lens) + np.arange(to[-1])]
        for k, i in enumerate(easy):
            first = self.fast.encode_ordinary(words[which[at[k]]])
            a, b = to[at[k]], to[at[k + 1] - 1]
            out[i] = np.concatenate([np.array(first, np.uint32), ids[a:b]])
        return out


def largest_id(path: str) -> int:
    """At least the largest id of the vocabulary, by its numbers alone: the driver needs no encoder."""
    with open(path, "rb") as f:
        return max(int(n) for n in re.findall(rb'":\s*(\d+)', f.read()))


def tails_of(path: str, window: int, end_id: int, with_ids: bool):
    """Rows of (task, doc_id, doc_tokens, chunk_crcs, chunk_ids, first_chunk, tail, tail_ids, nth): nth of its tail length in its task."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder, chunks, seen = Encoder.at(path), 0, Counter()
        for batch in batches:
            sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))])
            for a, b in slices(sizes, SLICE_BYTES):
                cols: dict[str, list] = defaultdict(list)
                for ids in encoder.many([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]):
                    raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                    n = len(raw) // 4
                    whole = [raw[4 * i : 4 * (i + window)] for i in range(0, n - n % window, window)]
                    cols["doc_tokens"].append(n)
                    cols["chunk_crcs"].append([zlib.crc32(x) for x in whole])
                    cols["chunk_ids"].append([np.frombuffer(x, "<u4").astype(small).tobytes() for x in whole] if with_ids else None)
                    cols["first_chunk"].append(chunks)
                    tail = n % window
                    cols["tail"].append(tail)
                    cols["tail_ids"].append(np.frombuffer(raw[4 * (n - tail) :], "<u4").astype(small).tobytes())
                    cols["nth"].append(seen[tail])
                    seen[tail] += 1
                    chunks += len(whole)
                kinds = {"doc_tokens": pa.int64(), "chunk_crcs": pa.list_(pa.int64()), "chunk_ids": pa.list_(pa.binary()), "first_chunk": pa.int64(), "tail": pa.int32(), "tail_ids": pa.binary(), "nth": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array([task] * (b - a), pa.int32()), batch.column(0).slice(a, b - a), *(pa.array(cols[k], t) for k, t in kinds.items())], names=["task", "doc_id", *kinds])

    def whole(batches):
        yield from run(batches)
        _ENCODERS.clear()  # workers live on for other tasks, which need no encoder
        tidy()

    return whole, (small := "<u2" if largest_id(path) < 1 << 16 else "<u4")


TAILS = "task int, doc_id long, doc_tokens long, chunk_crcs array<long>, chunk_ids array<binary>, first_chunk long, tail int, tail_ids binary, nth long"


# ---------------------------------------------------------------- the plan
def combinations(histogram: dict[int, int], window: int) -> list[tuple[int, ...]]:
    """Combinations of two to four lengths that fill a window: all pairs, triples and fours of frequent lengths."""
    have = set(histogram)
    found = {tuple(sorted((a, window - a))) for a in have if window - a in have}
    often = [n for n, _ in Counter(histogram).most_common(72)]
    for i, a in enumerate(often):
        for b in often[i:]:
            if (c := window - a - b) in have:
                found.add(tuple(sorted((a, b, c))))
    for i, a in enumerate(often[:20]):
        for j, b in enumerate(often[i:20], i):
            for c in often[j:20]:
                if (d := window - a - b - c) in have:
                    found.add(tuple(sorted((a, b, c, d))))
    return sorted(found)


def nonnegative_least_squares(columns: list[dict[int, int]], goal: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """x >= 0 that makes |A x - goal| least, by coordinate descent; columns of A are sparse."""
    x, rest = np.zeros(len(columns)), goal.astype(float)
    norms = [sum(v * v for v in c.values()) for c in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, c in enumerate(columns):
            step = max(-x[j], sum(rest[k] * v for k, v in c.items()) / norms[j])
            if step:
                x[j] += step
                for k, v in c.items():
                    rest[k] -= step * v
                moved = max(moved, abs(step))
        if moved < 0.01:
            break
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, slack: int = SLACK):
    """Slots (length, from, to, sequence, offset) for ranks from..to of a length, one sequence each; what remains as
    (length, from, position) in the stream of cut tails; the number of sequences before the stream."""
    left = {n: c for n, c in histogram.items() if n > 0 and c > 0}
    shapes = combinations(left, window)
    goal = np.zeros(window + 1)
    for n, c in left.items():
        goal[n] = c
    repeats = nonnegative_least_squares([Counter(s) for s in shapes], goal) if shapes else []
    used: Counter = Counter()
    slots, sequence = [], 0

    def place(shape: tuple[int, ...], times: int) -> None:
        nonlocal sequence
        at = 0
        for n in shape:
            slots.append((n, used[n], used[n] + times, sequence, at))
            used[n] += times
            left[n] -= times
            at += n
        sequence += times

    for shape, x in sorted(zip(shapes, repeats), key=lambda p: -p[1]):
        times = min(int(x + 1e-6), *(left[n] // k for n, k in Counter(shape).items()))
        if times > 0:
            place(shape, times)
    lengths = sorted((n for n in left if left[n] > 0), reverse=True)
    for top in lengths:
        while left[top] > 0:
            shape, room = [], window
            for n in lengths:
                if n > top or left[n] <= 0 or n > room:
                    continue
                k = min(left[n], room // n)
                shape += [n] * k
                room -= n * k
                if room <= slack:
                    break
            if room > slack or top not in shape:
                break
            place(tuple(shape), min(left[n] // k for n, k in Counter(shape).items()))
    stream, position = [], 0
    for n in sorted(left, reverse=True):
        if left[n] > 0:
            stream.append((n, used[n], position))
            position += n * left[n]
    return slots, stream, sequence, position


# ---------------------------------------------------------------- the operator
def cut_tails(window: int, small: str, with_ids: bool):
    """One or two pieces of each placed tail."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = defaultdict(list)
            for doc, n, tail, ids, seq, at in zip(*(c.to_pylist() for c in batch.columns)):
                raw = np.frombuffer(ids, small).astype("<u4").tobytes()
                done = 0
                while done < tail:
                    k = min(tail - done, window - at)
                    piece = raw[4 * done : 4 * (done + k)]
                    for name, v in zip(PIECES, (doc, n - tail + done, k, zlib.crc32(piece), n, seq, at, piece if with_ids else None)):
                        out[name].append(v)
                    done, seq, at = done + k, seq + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in PIECES.items()], names=list(PIECES))

    return run


def widen(small: str):
    """Whole windows with ids of 32 bits."""

    def run(batches):
        for batch in batches:
            ids = [None if x is None else np.frombuffer(x, small).astype("<u4").tobytes() for x in batch.column(7).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(ids, pa.binary())], names=list(PIECES))

    return run


PIECES = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "ids": pa.binary()}
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """The pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids); ids are little-endian 32-bit."""
    spark = docs.sparkSession
    ship(spark)
    encode, small = tails_of(vocabulary or default_vocabulary(), window, end_id, with_ids)
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, TAILS), "tails")
    counts = rows.groupBy("tail", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["tail"]: r["n"] for r in counts.groupBy("tail").agg(F.sum("n").alias("n")).collect()}
    slots, stream, first_cut, cut = plan(histogram, window)
    by_length = defaultdict(lambda: ([], None, None))
    for n, a, b, seq, at in slots:
        by_length[n][0].append((a, b, seq, at))
    for n, a, position in stream:
        by_length[n] = (by_length[n][0], a, position)
    last = first_cut + -(-cut // window)
    places = spark.createDataFrame([(n, s, a, p) for n, (s, a, p) in by_length.items()], "tail int, slots array<struct<a:long,b:long,seq:long,at:long>>, cut_from long, cut_at long")
    before = Window.partitionBy("tail").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("above", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # at most window - 1 rows of places, so their broadcast has a bound
    tails = rows.filter("tail > 0").join(ranks, ["tail", "task"]).join(F.broadcast(places), "tail").withColumn("rank", F.col("above") + F.col("nth"))
    slot = F.expr("get(filter(slots, s -> rank >= s.a and rank < s.b), 0)")
    position = F.col("cut_at") + (F.col("rank") - F.col("cut_from")) * F.col("tail")
    is_cut = F.col("rank") >= F.col("cut_from")
    tails = tails.withColumn("slot", slot).select(
        "doc_id", "doc_tokens", "tail", "tail_ids",
        F.when(is_cut, F.lit(first_cut) + F.floor(position / window)).otherwise(F.col("slot.seq") + F.col("rank") - F.col("slot.a")).cast("long").alias("seq"),
        F.when(is_cut, position % window).otherwise(F.col("slot.at")).cast("long").alias("at"),
    )
    placed = tails.mapInArrow(tidied(cut_tails(window, small, with_ids)), PIECES_DDL)
    # whole windows are sequences of their own, numbered by task
    per_task = rows.groupBy("task").agg(F.sum(F.size("chunk_crcs")).alias("chunks"))
    per_task = per_task.select("task", F.coalesce(F.sum("chunks").over(Window.partitionBy().orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    full = rows.filter(F.size("chunk_crcs") > 0).join(per_task, "task").select("doc_id", "doc_tokens", (F.col("earlier") + F.col("first_chunk") + last).alias("base"), "chunk_ids", F.posexplode("chunk_crcs").alias("i", "crc"))
    full = full.select("doc_id", (F.col("i") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", (F.col("base") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.expr("get(chunk_ids, i)").alias("ids"))
    return placed.unionByName(full.mapInArrow(tidied(widen(small)), PIECES_DDL) if with_ids else full)
