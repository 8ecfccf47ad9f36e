"""Substring dedup with difference-cover anchors.

A window is 20 consecutive words. Two equal windows at any two places share a shift d < 13 that brings both onto
positions in a difference cover modulo 13, so each holds an equal 8-word anchor at a cover position. Round one hashes
anchors at cover positions only (4 of 13) and asks which occur more than once. Round two extends: a window that
contains a repeated anchor is compared whole, by the hash of its 20 words, with every other such window; of equal windows
the first in (doc_id, position) order stays, the words of the others go.

Layout: documents lie in blocks by a hash of id and text. A block asks each part of the hash space about its distinct keys,
in the second round with the document of each key's first occurrence, and gets one bit a key; a passage in a third of all
texts is one key a block.

Cases: null and empty texts have no words; rows that repeat a doc_id count in the order of a hash of their texts, rows with a
null doc_id come last, in that order; whole repeated rows one after the other; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm.common import LOOKUP, asked, bits_of, block_words, expand, from_planes, grams, in_blocks, keys_of, member, ordered, pack, part_of, planes, repeated, ship, squeeze, table, within

#: A perfect difference cover: every residue modulo 13 is a difference of two of these.
PERIOD, COVER = 13, (0, 1, 3, 9)
WINDOW = 20
GRAM = WINDOW - PERIOD + 1
BLOCK_BYTES, PART_BYTES = 8 << 20, 8 << 20
_LAST = np.iinfo(np.int64).max


def anchors(h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where cover positions hold a whole anchor, and the anchor's hash."""
    whole = within(doc, GRAM)
    place = (np.arange(len(whole)) - at[doc[: len(whole)]]) % PERIOD
    spots = np.flatnonzero(whole & np.isin(place, COVER))
    return spots, grams(h, GRAM)[spots]


def windows(h, doc, at, spots, marked) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows that contain a marked anchor."""
    whole = within(doc, WINDOW)
    hit = np.zeros(len(h) + PERIOD + 1, np.int32)
    hit[spots[marked] + 1] = 1
    seen = np.cumsum(hit)
    n = len(whole)
    starts = np.flatnonzero(whole & (seen[PERIOD : PERIOD + n] > seen[:n]))
    return starts, grams(h, WINDOW)[starts]


def first_round(parts: int):
    def ask(docs: pa.Table) -> pa.Table:
        docs = ordered(docs)
        h, doc, at = block_words(docs.column("text"), False)
        keys = np.unique(anchors(h, doc, at)[1])
        return table(pack(part_of(keys, parts), keys, docs.column("block")[0].as_py()))

    def answer(data: pa.Table) -> pa.Table:
        rows = keys_of(data)
        twice = repeated(np.sort(np.concatenate([k for *_, k in rows])))
        return table([(p, b, 0, np.packbits(member(k, twice)).tobytes()) for p, b, k in rows])

    return ask, answer


def send_first(parts: np.ndarray, keys: np.ndarray, ids: np.ndarray, ties: np.ndarray, block: int) -> list[tuple]:
    """Sorted keys with the document of each first occurrence, as one row for each part."""
    edges = [0, *(np.flatnonzero(np.diff(parts)) + 1), len(parts)]
    return [(int(parts[a]), block, 0, squeeze(keys[a:b]) + planes(ids[a:b]) + planes(ties[a:b])) for a, b in zip(edges[:-1], edges[1:]) if b > a]


def received_first(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // 20
    return expand(data[: 8 * n]), from_planes(data[8 * n : 16 * n], np.int64), from_planes(data[16 * n :], np.uint32)


def candidates(docs: pa.Table, bits, parts: int):
    h, doc, at = block_words(docs.column("text"), False)
    spots, keys = anchors(h, doc, at)
    distinct, where, counts = np.unique(keys, return_inverse=True, return_counts=True)
    marked = (bits(asked(distinct, parts)) | (counts > 1))[where] if len(keys) else np.zeros(0, bool)
    return (h, doc, at, *windows(h, doc, at, spots, marked)), marked


def second_round(parts: int):
    def ask(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return table([])
        docs = ordered(docs)
        block = docs.column("block")[0].as_py()
        found, marked = candidates(docs, lambda counts: bits_of(answers, 0, counts), parts)
        keys, first = np.unique(found[-1], return_index=True)
        owner = found[1][found[3][first]]
        ids = docs.column("doc_id").cast(pa.int64()).fill_null(_LAST).to_numpy()[owner]
        rows = send_first(part_of(keys, parts), keys, ids, docs.column("tie").to_numpy()[owner].astype(np.uint32), block)
        return table([*rows, (block % parts, block, 1, np.packbits(marked).tobytes())])

    def answer(data: pa.Table) -> pa.Table:
        every = zip(*[data.column(c).to_pylist() for c in ("part", "block", "kind", "data")])
        rows = [(p, b, *received_first(d)) for p, b, k, d in sorted(every) if k == 0]
        out = []
        if rows:
            keys, ids, ties = (np.concatenate([r[i] for r in rows]) for i in (2, 3, 4))
            blocks = np.concatenate([np.full(len(r[2]), r[1], np.int32) for r in rows])
            order = np.lexsort((blocks, ties, ids, keys))
            keys, blocks = keys[order], blocks[order]
            head = np.concatenate([[True], keys[1:] != keys[:-1]])
            distinct, first = keys[head], blocks[head]
            out = [(p, b, 0, np.packbits(first[np.searchsorted(distinct, k)] != b).tobytes()) for p, b, k, *_ in rows]
        out += [(p, b, 1, d) for p, b, k, d in zip(*[data.column(c).to_pylist() for c in ("part", "block", "kind", "data")]) if k == 1]
        return table(out)

    def apply(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        docs = ordered(docs)
        state = next(d for k, d in zip(answers.column("kind").to_pylist(), answers.column("data").to_pylist()) if k == 1)
        h, doc, at = block_words(docs.column("text"), False)
        spots, _ = anchors(h, doc, at)
        marked = np.unpackbits(np.frombuffer(state, np.uint8), count=len(spots)).astype(bool)
        starts, keys = windows(h, doc, at, spots, marked)
        distinct, first, where = np.unique(keys, return_index=True, return_inverse=True)
        gone = np.zeros(0, bool)
        if len(keys):
            gone = bits_of(answers, 0, asked(distinct, parts))[where]
            gone |= first[where] != np.arange(len(keys))
        cover = np.zeros(len(h) + 1, np.int32)
        s = starts[gone]
        cover[s] += 1
        np.subtract.at(cover, s + WINDOW, 1)
        removed = np.cumsum(cover[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(removed)])
        n_removed = total[at[1:]] - total[at[:-1]]
        texts = []
        for i, text in enumerate(docs.column("text").to_pylist()):
            words = (text or "").encode().split()
            if n_removed[i]:
                keep = ~removed[at[i] : at[i + 1]]
                words = [w for w, k in zip(words, keep.tolist()) if k]
            texts.append(b" ".join(words).decode())
        return pa.table({"doc_id": docs.column("doc_id").cast(pa.int64()), "n_words": pa.array(np.diff(at), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(texts, pa.string())})

    return ask, answer, apply


def dedup_substrings(docs: DataFrame, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of each document."""
    ship(docs.sparkSession)
    blocked, parts = in_blocks(docs, block_bytes, part_bytes)
    ask1, answer1 = first_round(parts)
    ask2, answer2, apply = second_round(parts)
    one = blocked.groupBy("block").applyInArrow(ask1, LOOKUP).groupBy("part").applyInArrow(answer1, LOOKUP)
    two = blocked.groupBy("block").cogroup(one.groupBy("block")).applyInArrow(ask2, LOOKUP).groupBy("part").applyInArrow(answer2, LOOKUP)
    return blocked.groupBy("block").cogroup(two.groupBy("block")).applyInArrow(apply, "doc_id long, n_words long, n_removed long, kept_text string")
