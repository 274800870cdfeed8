"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact check.

For each benchmark item, every window of a document with as many words as the
item has a SimHash fingerprint of its word shingles, weighted by how often each
occurs; a document with fewer words is one window, if it has shingles enough
for the similarity. A fingerprint within ``radius`` bits of the item's differs
from it in at most ``radius // 4`` bits of at least one of its four blocks of 16
bits, so an index by block, probed at all values within so many bits, misses
none (at radius 15 it passes 4 % of unrelated pairs); those it finds are compared
by the weighted Jaccard similarity of their shingles.

Fingerprints of a window and an item of similarity 0.8 differ in 9.7 bits on
average (deviation 2.9), so that a radius of 15 holds 98 % of those at the very
threshold and practically all above; a window's neighbours, which share all but
one shingle with it, are further chances.

Windows that hold no shingle of an item have similarity 0 with it, so windows
are only laid around places with a shingle of the benchmark. The benchmark is
taken in shares of at most ``share_words`` words: each is broadcast, which
bounds its size, and costs one pass over the documents. Passes are map stages;
documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillon.llm.common import WordHashes, shingle_hashes, words

BITS = np.arange(64, dtype=np.uint64)
#: Blocks of a fingerprint, the bits of each, and the (window, item) pairs that are looked at together.
BLOCKS, WIDTH, PAIRS = 4, 16, 2_000_000


@dataclass(frozen=True)
class Settings:
    size: int = 5
    similarity: float = 0.8
    radius: int = 15
    share_words: int = 2_000_000


def signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    return ((h[:, None] >> BITS) & np.uint64(1)).astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.bitwise_or.reduce((sums > 0).astype(np.uint64) << BITS, axis=1)


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard: the smaller by the larger weight, summed over shingles; a weight is a count."""
    keys, back = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = (np.bincount(part, minlength=len(keys)) for part in (back[: len(x)], back[len(x) :]))
    return float(np.minimum(a, b).sum() / np.maximum(a, b).sum())


class Index:
    """Items by number of words, then by block of their fingerprint."""

    def __init__(self, items: list[tuple[object, str]], s: Settings):
        self.s, known = s, WordHashes()
        self.ids, self.shingles, sizes = [], [], []
        for i, text in items:
            h = known.of(words(text))
            if len(h):
                self.ids.append(i)
                self.shingles.append(shingle_hashes(h, s.size))
                sizes.append(len(h))
        self.fps = np.array([fingerprints(signs(x).sum(0, keepdims=True))[0] for x in self.shingles], np.uint64)
        values = np.arange(1 << WIDTH, dtype=np.uint64)
        self.flips = values[np.bitwise_count(values) <= s.radius // BLOCKS]
        self.lengths = {}
        for n in sorted(set(sizes)):
            own = np.array([k for k, size in enumerate(sizes) if size == n])
            tables = []
            for block in range(BLOCKS):
                value = self.block(self.fps[own], block)
                order = np.argsort(value, kind="stable")
                value, first, count = np.unique(value[order], return_index=True, return_counts=True)
                tables.append((value, first, count, own[order]))
            keys = np.unique(np.concatenate([self.shingles[k] for k in own]))
            self.lengths[n] = (min(n, s.size), tables, keys)
        self.keys = {}
        for k in {min(n, s.size) for n in self.lengths}:
            keys = np.unique(np.concatenate([x[2] for x in self.lengths.values() if x[0] == k]))
            bits = np.zeros(1 << 20, bool)
            bits[(keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.keys[k] = (keys, bits)

    @staticmethod
    def block(fps: np.ndarray, k: int) -> np.ndarray:
        return (fps >> np.uint64(k * WIDTH)) & np.uint64((1 << WIDTH) - 1)

    def probed(self, values: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``value``, place in ``values``) of the index's values that differ in few enough bits.

        Either all values of the index are held against a block or all values
        near the block are looked up, whichever are fewer.
        """
        if len(values) <= len(self.flips):
            return np.nonzero(np.bitwise_count(value[:, None] ^ values) <= self.s.radius // BLOCKS)
        near = value[:, None] ^ self.flips
        there = np.zeros(1 << WIDTH, bool)
        there[values.astype(np.int64)] = True
        w, f = np.nonzero(there[near.astype(np.int64)])
        return w, np.searchsorted(values, near[w, f])

    def candidates(self, tables: list, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs whose fingerprints differ in ``radius`` bits at most."""
        out, step = [], max(1, PAIRS // max(min(len(self.flips), len(tables[0][0])), len(tables[0][3])))
        for at in range(0, len(fps), step):
            part, pairs = fps[at : at + step], []
            for k, (values, first, count, own) in enumerate(tables):
                w, v = self.probed(values, self.block(part, k))
                n = count[v]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pairs.append(np.repeat(w, n) * len(self.ids) + own[np.repeat(first[v], n) + inner])
            found = np.unique(np.concatenate(pairs))
            w, k = found // len(self.ids), found % len(self.ids)
            near = np.bitwise_count(part[w] ^ self.fps[k]) <= self.s.radius
            out.append((w[near] + at, k[near]))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def search(self, h: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """Item number to (similarity, first word, words) of its best window in a document's word hashes."""
        best: dict[int, tuple[float, int, int]] = {}
        found = {}
        for k, (keys, bits) in self.keys.items():
            if len(h) >= k:
                x = shingle_hashes(h, k)
                hit = np.flatnonzero(bits[(x & np.uint64(0xFFFFF)).astype(np.int64)])
                hit = hit[keys[np.minimum(np.searchsorted(keys, x[hit]), len(keys) - 1)] == x[hit]]
                if len(hit):
                    found[k] = (x, hit)
        if not found:
            return best
        for n, (k, tables, keys) in self.lengths.items():
            if k not in found:
                continue
            x, hit = found[k]
            m = min(n - k + 1, len(x))  # a document shorter than the item is one window
            if m / (n - k + 1) < self.s.similarity:
                continue
            hit = hit[keys[np.minimum(np.searchsorted(keys, x[hit]), len(keys) - 1)] == x[hit]]
            low, high = np.maximum(hit - m + 1, 0), np.minimum(hit, len(x) - m)
            if not len(hit):
                continue
            cut = np.flatnonzero(low[1:] > high[:-1] + 1) + 1
            for a, b in zip(low[np.concatenate([[0], cut])], high[np.concatenate([cut - 1, [len(high) - 1]])], strict=True):
                for at in range(int(a), int(b) + 1, 4096):  # bounds the sums of long stretches
                    end = min(int(b) + 1, at + 4096)
                    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(x[at : end + m - 1]), axis=0, dtype=np.int32)])
                    w, item = self.candidates(tables, fingerprints(total[m:] - total[:-m]))
                    for i, j in zip(w.tolist(), item.tolist(), strict=True):
                        score = similarity(x[at + i : at + i + m], self.shingles[j])
                        if score >= self.s.similarity and (j not in best or score > best[j][0]):
                            best[j] = (score, at + i, min(n, len(h)))
        return best


def indexes(items: DataFrame, id_col: str, text: str, s: Settings) -> Iterator[Index]:
    """One index for each share of the benchmark; items without a word are left out."""
    size = F.size(F.split(F.col(text), r"[\x20\x09-\x0D]+"))
    known = items.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    total = known.agg(F.sum(size)).first()[0] or 0
    shares = max(1, -(-2 * total // s.share_words)) if total > s.share_words else 1
    for k in range(shares):
        own = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(shares)) == k)
        yield Index([(r["id"], r["text"]) for r in sorted(own.collect(), key=lambda r: (str(r["id"]), r["text"]))], s)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", s: Settings = Settings()) -> DataFrame:
    """(``id_col``, ``item_id``, ``similarity``, ``first_word``, ``n_words``) for each document and item it holds.

    The best window is given, the first of equally good ones. Null and empty
    texts hold nothing, items without words are in nothing; an item without an
    id is found with a null one; repeated rows are each searched. Documents
    without a leak have no row.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType, items.schema[item_id].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField(item_id, item_kind), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])
    item_arrow = to_arrow_type(item_kind)
    out = None
    for index in indexes(items, item_id, item_text, s):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, known = shared.value, WordHashes()
            for batch in batches:
                take, rows = [], []
                for k, t in enumerate(batch.column(1)):
                    for j, (score, at, n) in sorted(index.search(known.of(words(t.as_py()))).items()):
                        take.append(k)
                        rows.append((index.ids[j], score, at, n))
                cols = list(zip(*rows, strict=True)) or [()] * 4
                ids = batch.column(0).take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(cols, (item_arrow, pa.float64(), pa.int64(), pa.int64()), strict=True)]], names=schema.names)

        found = docs.select(id_col, text).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are."""
    for index in indexes(items, item_id, item_text, s):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, known = shared.value, WordHashes()
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text))
                yield batch.filter(pa.array([not index.search(known.of(words(t.as_py()))) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
