"""Shared pieces: checkpoint folder, shipping the package, document blocks, byte-level words and hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of a word boundary, and the letters that lower-casing changes.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same words as a regular expression of the JVM.
WORD_RE = r"[^\x20\x09-\x0D]+"

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32

#: An odd base for polynomial hashes modulo 2**64, its inverse, and a random value for each byte.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# ---------------------------------------------------------------- session
def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder, or one of our own where it is unset."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = f"file:///tmp/checkpoints/{os.getpid()}"
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    Once the table is there the shuffle files behind it have no use; Spark drops them at the end of the write.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table_ = spark.read.schema(df.schema).parquet(path)
    table_._folioscope_path = path
    return table_


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._folioscope_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_key(docs: DataFrame) -> DataFrame:
    """doc_id and text with k1, k2: 128 bits of both, so that nulls and repeated ids spread and equal rows have equal keys."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(7), "text", "doc_id")})


def enrich(rows: DataFrame, facts: DataFrame, keys: list[str], hot: Column, how: str = "left") -> DataFrame:
    """rows joined with facts. Facts that are hot, by a share of all rows that bounds their number, join by broadcast, the rest by merge."""
    hot = F.coalesce(hot, F.lit(False))
    first = rows.join(F.broadcast(facts.filter(hot).withColumn("__hot", F.lit(True))), keys, "left")
    known = first.filter("__hot").drop("__hot")
    rest = first.filter("__hot is null").select(*rows.columns).join(facts.filter(~hot).hint("merge"), keys, how)
    return known.unionByName(rest)


#: Ids that are broadcast, at most: 16 MB.
FEW = 300_000


def split_by_ids(rows: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose column is surely not among ids (one column), and the others. If the counted ids are more than FEW, all are others.

    The first part is not moved, so that a merge join behind this moves few rows where few ids matter.
    """
    if ids.count() > FEW:
        return rows.limit(0), rows
    (name,) = ids.columns
    marked = rows.join(F.broadcast(ids.select(F.col(name).alias("__known"), F.lit(True).alias("__hit"))), F.col(column).cast("long").eqNullSafe(F.col("__known")), "left")
    return marked.filter("__hit is null").select(*rows.columns), marked.filter("__hit").select(*rows.columns)


#: Rows of texts that Spark and a Python worker exchange at a time; its usual 10000 rows of long texts fill hundreds of MB.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application; and small Arrow batches, unless the session has set its own."""
    sc = spark.sparkContext
    if spark.conf.get(ARROW_ROWS, "10000") == "10000":
        spark.conf.set(ARROW_ROWS, BATCH_ROWS)
    if getattr(sc, "_folioscope_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):
        path = os.path.join(tempfile.mkdtemp(), "folioscope.zip")
        with zipfile.ZipFile(path, "w") as z:
            for d, _, names in os.walk(root):
                for x in sorted(names):
                    if x.endswith(".py"):
                        z.write(os.path.join(d, x), os.path.relpath(os.path.join(d, x), os.path.dirname(root)))
        sc.addPyFile(path)
    sc._folioscope_shipped = True


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold_of(doc_id: Column, modulus: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def text_bytes(docs: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of their texts."""
    n, b = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return int(n), int(b)


# ---------------------------------------------------------------- texts as bytes
def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the offsets of each (one more than rows). A null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.type != pa.large_binary():
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, column.offset + len(column) + 1)[column.offset :] if at is not None and at.size else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """Row ranges (a, b) whose texts hold at most so many bytes together, or one longer text alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i up to n, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        m = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit; x is overwritten."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with hash(buf[a:b]) = (P[b] - P[a]) * base**-a."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[buf] * up[: len(buf)], out=out[1:])
    return out


class Words:
    """Words of a run of texts: where each starts and ends, its text, and a 64-bit hash."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool):
        self.buf = buf = TO_LOWER[buf] if lower else buf
        self.offsets = offsets
        n = len(buf)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        solid = ~IS_SPACE[buf]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = True, True
            before[1:] = ~solid[:-1]
            after[:-1] = ~solid[1:]
        self.start = np.flatnonzero(solid & (before | first[:n]))
        self.end = np.flatnonzero(solid & (after | first[1:])) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        #: The first word of each text, and one past the last of all.
        self.at = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        p = prefix_hash(self.buf)
        _, down = powers(len(self.buf) + 1)
        h = (p[self.end] - p[self.start]) * down[self.start]
        h += (self.end - self.start).astype(np.uint64)
        return mix(h)

    def position(self) -> np.ndarray:
        """The number of each word in its text."""
        return np.arange(len(self.start)) - self.at[self.doc]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values of h, by doubling; len(h) - k + 1 of them."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, length, power, size, at = None, 0, h.copy(), 1, BASE
    while True:
        if k & size:
            if out is None:
                out, length = power.copy(), size
            else:  # what came before stands left of this
                m = len(h) - (length + size) + 1
                out = out[:m] * at + power[length : length + m]
                length += size
        size <<= 1
        if size > k:
            break
        m = len(h) - size + 1
        power = power[:m] * at + power[size >> 1 : (size >> 1) + m]
        at = np.uint64(int(at) * int(at) % 2**64)
    return mix(out.copy())


def within(doc: np.ndarray, k: int) -> np.ndarray:
    """Which runs of k consecutive words lie in one text."""
    return doc[: len(doc) - k + 1] == doc[k - 1 :] if len(doc) >= k else np.zeros(0, bool)


# ---------------------------------------------------------------- blocks and lookups
def in_blocks(docs: DataFrame, block_bytes: int, part_bytes: int) -> tuple[DataFrame, int]:
    """doc_id, text, tie (a hash of the text) and a block number by a hash of doc_id and text, so that neither nulls nor a
    repeated id make a block large; and the number of parts of a key space. Blocks and parts have sizes of their own: a block
    sends each part one row at most, and never more rows than it has keys."""
    spark = docs.sparkSession
    rows, size = text_bytes(docs)
    many = lambda each: max(1, min(rows, max(partitions(spark), -(-size // each))))
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = kept.withColumn("tie", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)))
    return kept.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(many(block_bytes))).cast("int")), many(part_bytes)


LOOKUP = "part int, block int, kind int, data binary"


def pack(parts: np.ndarray, keys: np.ndarray, block: int, kind: int = 0) -> list[tuple]:
    """Sorted keys, whose parts are sorted too, as one row for each part."""
    edges = np.flatnonzero(np.diff(parts)) + 1
    return [(int(x[0]), block, kind, squeeze(y)) for x, y in zip(np.split(parts, edges), np.split(keys, edges)) if len(x)]


def table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], names=["part", "block", "kind", "data"])


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each 64-bit key, from its high bits, so that sorted keys have sorted parts."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


#: Bytes of text that are turned into words and hashes at a time, which bounds memory within a block.
SLICE = 1 << 20


def block_words(column, lower: bool, hashed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts in order: the hash of each word, its text's number, and where each text's words begin."""
    buf, offsets = text_buffer(column)
    hashes, docs, counts = [], [], []
    for a, b in slices(offsets, SLICE):
        w = Words(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower)
        if hashed:
            hashes.append(w.hashes())
        docs.append(w.doc + a)
        counts.append(np.diff(w.at))
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(hashes, np.uint64), join(docs, np.int64), np.concatenate([[0], np.cumsum(join(counts, np.int64))])


def keys_of(data: pa.Table, kind: int = 0) -> list[tuple[int, int, np.ndarray]]:
    """(part, block, keys) of each row of that kind, by part."""
    cols = [data.column(c).to_pylist() for c in ("part", "block", "kind", "data")]
    return sorted(((p, b, expand(d)) for p, b, k, d in zip(*cols) if k == kind), key=lambda x: x[:2])


def bits_of(data: pa.Table, kind: int, counts: np.ndarray) -> np.ndarray:
    """One bit for each key of a block, sorted by key: the answers of all parts, of which counts says how many keys each got."""
    cols = [data.column(c).to_pylist() for c in ("part", "kind", "data")]
    got = {p: d for p, k, d in zip(*cols) if k == kind}
    found = [np.unpackbits(np.frombuffer(got[p], np.uint8), count=int(n)) for p, n in enumerate(counts) if n]
    return np.concatenate(found).astype(bool) if found else np.zeros(0, bool)


def repeated(sorted_keys: np.ndarray) -> np.ndarray:
    """The distinct keys that occur more than once."""
    same = sorted_keys[1:] == sorted_keys[:-1]
    return np.unique(sorted_keys[1:][same])


def member(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array of."""
    if not len(of):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(of, keys)
    at[at == len(of)] = 0
    return of[at] == keys


def ordered(docs: pa.Table) -> pa.Table:
    """By doc_id (nulls last); rows that repeat one by a hash of their texts."""
    return docs.sort_by([("doc_id", "ascending"), ("tie", "ascending"), ("text", "ascending")])


def planes(x: np.ndarray) -> bytes:
    """Numbers with their bytes side by side by place, so that the high ones, mostly zero, compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def from_planes(data, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def squeeze(sorted_keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return planes(np.diff(sorted_keys, prepend=np.uint64(0)))


def expand(data) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64))


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs: Spark drops them once the driver has collected their handles."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy() -> None:
    """Give memory that numpy and Arrow no longer use back to the system; workers live longer than their tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run):
    """A function of mapInArrow that tidies up after its partition."""

    def whole(batches):
        yield from run(batches)
        tidy()

    return whole


def asked(keys: np.ndarray, parts: int) -> np.ndarray:
    """How many of the keys go to each part."""
    return np.bincount(part_of(keys, parts), minlength=parts)


def shrink(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def grow(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)
