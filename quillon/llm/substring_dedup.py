"""Repeated substrings: every byte under a string of ``length`` bytes that starts earlier too.

A suffix array sorts all suffixes, so that repeats stand side by side. Sorted as
rows that takes ten and more bytes of shuffle for each byte of text; here only
what can decide about a repeat is sorted, bucket by bucket:

* A cover sample of positions is drawn so that any two equal windows of
  ``length`` bytes hold a sampled position at one and the same offset: the
  smallest hash among the ``gram``-byte strings in the window. The sample is a
  cover by content where a difference cover is one by arithmetic, about one
  position in 35, and each window belongs to one sampled position.
* The bucket of a sampled position is its gram. Two windows can only be equal
  within a bucket, so one bucket is sorted at a time, the sampled positions
  first: by the hash of all that their windows span (the rank that resolves long
  ties at once). One span twice means that all windows of the later are repeats;
  a gram that stands once means that none is.
* Only where a bucket holds different spans, at the ends of repeats, are the
  windows themselves sorted, from their bytes, and the first of each kept.

Copies fold together in three places before they meet: within a worker's
share of the text, per span, and per window. Memory is bounded by the block
sizes below; buckets of more than ``hot`` spans are dealt out again by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import mixed, written

#: Multiplier of the rolling hashes and the value of each byte in them.
M = 0x9FB21C651E98DF25
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass(frozen=True)
class Settings:
    """``block``: sampled positions that a worker folds at a time; ``spans``: spans whose windows it sorts at a time."""

    length: int = 100
    gram: int = 32
    block: int = 1_000_000
    spans: int = 8_000
    hot: int = 100_000
    piece: int = 1 << 19

    @property
    def width(self) -> int:
        """Grams in a window."""
        return self.length - self.gram + 1


def rolling(b: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` bytes, from those of half its size."""
    n = len(b) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, h, span = M, BYTES[b], 1
    acc, done = None, 0
    rest = size
    while rest:
        if rest & 1:
            part = h[done : done + n]
            acc = part.copy() if acc is None else acc * np.uint64(power) + part
            done += span
        rest >>= 1
        if rest:
            h = h[:-span] * np.uint64(power) + h[span:]
            power, span = power * power % (1 << 64), span * 2
    return acc


def sampled(b: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, position, first and last window start) of the sampled positions of one text."""
    out = []
    for at in range(0, len(b) - s.length + 1, s.piece):
        g = mixed(rolling(b[at : at + s.piece + s.length - 1], s.gram))
        # The smallest hash, the leftmost of equal ones: its high bits, then the place.
        key = (g & ~np.uint64((1 << 20) - 1)) | np.arange(len(g), dtype=np.uint64)
        low, span = key, 1
        while span * 2 <= s.width:
            low, span = np.minimum(low[:-span], low[span:]), span * 2
        n = len(g) - s.width + 1
        low = np.minimum(low[:n], low[s.width - span : s.width - span + n])
        place = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [n]]) - 1
        own = place[first]
        out.append((g[own], own + at, first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)


def merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the intervals; those that touch are one."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    cut = np.flatnonzero(starts[1:] > stops[:-1])
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), stops[np.concatenate([cut, [len(stops) - 1]])].tolist(), strict=True))


def runs_by_doc(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Merged intervals, as columns of doc, start and stop."""
    if not len(doc):
        return [], [], []
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        for x, y in merged(start[a:b], stop[a:b]):
            out[0].append(int(doc[a]))
            out[1].append(x)
            out[2].append(y)
    return out


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


#: ``gram``, ``span`` and ``at`` (place of the gram) are null in a row that tells of repeated bytes [start, stop).
SAMPLE = pa.schema([("gram", pa.int64()), ("span", pa.int64()), ("doc", pa.int64()), ("at", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])


def sample_rows(docs: DataFrame, s: Settings) -> DataFrame:
    """The cover sample of (id, text), folded block by block."""

    def folded(parts: list) -> pa.RecordBatch:
        gram, span, doc, at, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, doc, span, gram))
        gram, span, doc, at, first, last = (x[order] for x in (gram, span, doc, at, first, last))
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (span[1:] != span[:-1])])
        # Repeats of a span within the block; a repeated row of the input is none.
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        repeat = (doc != doc[head]) | (at != at[head])
        d, a, b = runs_by_doc(doc[repeat], first[repeat], last[repeat] + s.length)
        keep = np.flatnonzero(new)
        none = np.concatenate([np.zeros(len(keep), bool), np.ones(len(d), bool)])
        pad = np.zeros(len(d), np.int64)
        both = ((gram.view(np.int64), pad, none), (span.view(np.int64), pad, none), (doc, d, None), (at, pad, none), (first, a, None), (last + s.length, b, None))
        cols = [pa.array(np.concatenate([x[keep], np.array(y, np.int64)]), f.type, mask=m, safe=False) for (x, y, m), f in zip(both, SAMPLE, strict=True)]
        return pa.RecordBatch.from_arrays(cols, schema=SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                data = raw(t.as_py())
                if len(data) < s.length:
                    continue
                gram, at, first, last = sampled(np.frombuffer(data, np.uint8), s)
                stops = last + s.length
                span = np.fromiter((xxhash.xxh3_64_intdigest(data[a:z], p) for a, z, p in zip(first.tolist(), stops.tolist(), (at - first).tolist(), strict=True)), np.uint64, len(at))
                parts.append((gram, span, np.full(len(at), i.as_py(), np.int64), at, first, last))
                held += len(at)
                if held >= s.block:
                    yield folded(parts)
                    parts, held = [], 0
        if parts:
            yield folded(parts)

    return docs.mapInArrow(run, "gram long, span long, doc long, at int, start int, stop int")


def span_rows(shared: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of the spans that share their gram with another: (gram, doc, start, bytes)."""
    lists = shared.groupBy("doc").agg(F.collect_list(F.struct("gram", "start", "stop")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                rows = []
                for i, t, spans in zip(*(c.to_pylist() for c in whole.slice(at, 200).columns), strict=True):
                    data = raw(t)
                    rows += [(x["gram"], i, x["start"], data[x["start"] : x["stop"]]) for x in spans]
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["gram", "doc", "start", "bytes"])

    both = docs.join(lists, docs["id"] == lists["doc"]).select("id", "text", "spans")
    return both.mapInArrow(run, "gram long, doc long, start int, bytes binary")


def windows_of(start: np.ndarray, data: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, index of the span, start in its document) of each window of each span."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    h = rolling(np.frombuffer(b"".join(data), np.uint8), s.length)
    begin = np.cumsum(sizes) - sizes
    n = np.maximum(sizes - s.length + 1, 0)
    own = np.repeat(np.arange(len(data)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return h[begin[own] + inner], own, start[own] + inner


def equal_windows(data: list[bytes], start: np.ndarray, own: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, s: Settings, block: int = 50_000) -> np.ndarray:
    """Which windows ``a`` have the bytes of the windows ``b``, eight at a time."""
    text = np.frombuffer(b"".join(data) + bytes(8), np.uint8)
    words = np.lib.stride_tricks.as_strided(text, (len(text) - 7, 8), (1, 1))
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    place = (np.cumsum(sizes) - sizes)[own] + at - start[own]
    # The last word ends with the window and overlaps the one before it.
    steps = np.append(np.arange(0, s.length - 7, 8), s.length - 8)
    out = np.ones(len(a), bool)
    for k in range(0, len(a), block):
        x, y = place[a[k : k + block]], place[b[k : k + block]]
        for step in steps:
            out[k : k + block] &= (words[x + step] == words[y + step]).all(1)
    return out


REPEATS = "doc long, start int, stop int"


def repeats_batch(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    d, a, b = runs_by_doc(doc, start, stop)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["doc", "start", "stop"])


def sorted_buckets(spans: DataFrame, s: Settings) -> DataFrame:
    """Repeated bytes within buckets that one worker can hold: whole buckets, a block at a time."""

    def block(gram: np.ndarray, doc: np.ndarray, start: np.ndarray, data: list[bytes]) -> pa.RecordBatch:
        h, own, at = windows_of(start, data, s)
        d = doc[own]
        # Equal windows share a gram, and rows come by (gram, doc, start): the first index is the earliest.
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        head = first[back]
        again = (d != d[head]) | (at != at[head])
        again[again] = equal_windows(data, start, own, at, np.flatnonzero(again), head[again], s)
        return repeats_batch(d[again], at[again], at[again] + s.length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            gram = table.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1])) if len(gram) else 0
            edges = np.flatnonzero(np.concatenate([[True], gram[1:cut] != gram[: cut - 1]])) if cut else np.empty(0, np.int64)
            a = 0
            while a < cut:
                later = edges[edges > a + s.spans]
                b = int(later[0]) if len(later) else cut
                part = table.slice(a, b - a)
                yield block(gram[a:b], part.column("doc").to_numpy(), part.column("start").to_numpy().astype(np.int64), part.column("bytes").to_pylist())
                a = b
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield block(rest.column("gram").to_numpy(), rest.column("doc").to_numpy(), rest.column("start").to_numpy().astype(np.int64), rest.column("bytes").to_pylist())

    return spans.repartition("gram").sortWithinPartitions("gram", "doc", "start").mapInArrow(run, REPEATS)


def dealt_windows(spans: DataFrame, s: Settings) -> DataFrame:
    """Repeated bytes within hot buckets: a row for each window, the earliest by a pre-aggregated minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, s.spans):
                part = whole.slice(at, s.spans)
                h, own, place = windows_of(part.column(2).to_numpy().astype(np.int64), part.column(3).to_pylist(), s)
                gram, doc = (part.column(k).to_numpy()[own] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(h.view(np.int64)), pa.array(doc), pa.array(place.astype(np.int32))], names=["gram", "hash", "doc", "start"])

    each = spans.select("gram", "doc", "start", "bytes").mapInArrow(run, "gram long, hash long, doc long, start int")
    # By both hashes: at 10^12 windows one of 64 bits alone would join different ones.
    first = each.groupBy("gram", "hash").agg(F.min(F.struct("doc", "start")).alias("first"))
    again = each.join(first, ["gram", "hash"]).where((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    return again.select("doc", "start", (F.col("start") + s.length).alias("stop"))


def repeats(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Bytes [start, stop) of ``doc`` that stand under an earlier string; intervals may overlap. ``docs``: id, text."""
    docs = docs.where("id is not null")
    rows = sample_rows(docs, s)
    # One window sort by gram finds spans that repeat across blocks and grams that don't stand alone.
    w = Window.partitionBy("bucket").orderBy("span", "doc", "at")
    bucket = F.coalesce("gram", F.xxhash64("doc", "start"))
    seen = rows.withColumn("bucket", bucket).withColumn("before", F.lag(F.struct("span", "doc", "at")).over(w)).withColumn("after", F.lead("span").over(w))
    same = F.coalesce(F.col("before.span") == F.col("span"), F.lit(False))
    itself = F.coalesce((F.col("before.doc") == F.col("doc")) & (F.col("before.at") == F.col("at")), F.lit(False))
    repeat = F.col("gram").isNull() | (same & ~itself)
    lonely = F.col("before").isNull() & F.col("after").isNull()
    found = written(seen.withColumn("repeat", repeat).where(F.col("repeat") | ~lonely).select("gram", "doc", "start", "stop", "repeat"))
    shared = found.where("not repeat")
    spans = written(span_rows(shared, docs))
    hot = written(spans.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > s.hot).select("gram"))
    cool = sorted_buckets(spans.join(hot, "gram", "left_anti"), s)
    dealt = dealt_windows(spans.join(hot, "gram", "left_semi"), s)
    return found.where("repeat").select("doc", "start", "stop").unionByName(cool).unionByName(dealt)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", s: Settings = Settings(), texts: bool = False) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, with ``texts``, ``kept`` (binary).

    Ids are integers and order the documents; rows with one id must be repeats
    of one row, and are judged alike. A row without an id is kept whole and no
    other is held against it. Null texts count as empty, and those of fewer
    than ``length`` bytes are kept whole. Other columns aren't read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    found = written(repeats(own, s).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("runs")))
    schema = f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                rows = []
                for i, t, runs in zip(*(c.to_pylist() for c in whole.slice(at, 500).columns), strict=True):
                    data, gone, kept, last = raw(t), 0, [], 0
                    spans = merged(*(np.array([x[k] for x in runs or ()], np.int64) for k in ("start", "stop")))
                    for a, b in spans:
                        kept.append(data[last:a])
                        gone, last = gone + b - a, b
                    left = b"".join([*kept, data[last:]])
                    rows.append((i, len(data), gone, len(spans), hashlib.sha256(left).hexdigest(), left))
                cols = list(zip(*rows, strict=True)) or [()] * 6
                types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                size = 5 + texts
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:size], types, strict=False)], names=names[:size])

    return own.join(found, own["id"] == found["doc"], "left").select("id", "text", "runs").mapInArrow(run, schema)
