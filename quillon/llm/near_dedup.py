"""Near-duplicate documents: b-bit MinHash bands, packed signatures, exact confirmation.

1. One map over the texts gives each document its number of shingles, a 128-bit
   key of its shingle set, the band keys of its MinHash minima and a signature:
   the low bits of the minima of ``bins`` parts of the hash range, packed as bit
   planes into longs.
2. Documents with one set are one class from here on, represented by the
   smallest id: copies cost a row each, and never a pair.
3. Each band bucket links its classes to one of them, a different one in each
   round, never in all pairs. Signatures weed these out by the estimated
   similarity (bit counts, corrected for chance collisions of low bits), with a
   margin of five deviations; the full shingle sets of the rest confirm or
   reject. The first round takes the class that meets most others as the centre,
   which in a group of copies is the text that they were made from.
4. Buckets that still hold more than one component are searched within, block by
   block: only pairs of different components are estimated, then confirmed by
   their full sets, both in the task that holds the two blocks. This loses no
   link between components, whatever the stars missed, and a pair never is a
   row; the comparisons, not the rows, grow with the square of a bucket.
5. Components of the confirmed links.

With ``bands`` of ``rows`` minima, two documents of similarity s share no
bucket with probability ``(1 - s**rows)**bands``: 3e-6 at 0.8 for 32 of 5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import WordHashes, dropped, mixed, shingle_hashes, sifted, split_join, words, written
from quillon.llm.components import components


@dataclass(frozen=True)
class Settings:
    """``percent``: documents are linked at this Jaccard similarity, in hundredths, or more.
    ``rounds``: of stars, before pairs within buckets. ``block``: classes of a bucket that meet others at a time."""

    size: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    bits: int = 3
    bins: int = 1024
    margin: float = 5.0
    slack: float = 0.005
    rounds: int = 2
    block: int = 256

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def planes(self) -> int:
        """Longs of a signature."""
        return self.bits * self.bins // 64


class Hasher:
    def __init__(self, s: Settings):
        rng = np.random.default_rng(20240229)
        self.s = s
        self.a = rng.integers(0, 1 << 31, s.minima, np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, s.minima, np.uint32)
        self.known = WordHashes()

    def shingles(self, text: str | None) -> np.ndarray:
        """Distinct shingle hashes, sorted."""
        return np.unique(shingle_hashes(self.known.of(words(text)), self.s.size))

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(self.s.minima, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 1024):  # blocks that stay in the processor's cache
            h = np.multiply.outer(self.a, x[at : at + 1024])
            h += self.b[:, None]
            np.minimum(low, h.min(1), out=low)
        return low

    def bands(self, minima: np.ndarray) -> np.ndarray:
        acc = np.arange(1, self.s.bands + 1, dtype=np.uint64)
        for column in minima.reshape(self.s.bands, self.s.rows).T:
            acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + column)
        return acc.view(np.int64)

    def packed(self, shingles: np.ndarray) -> np.ndarray:
        """Bit planes: long ``j * bits + i`` holds bit ``i`` of bins ``64 * j`` and on; 0 stands for an empty bin.

        Shingles are sorted, so the least of a bin is its first.
        """
        own = (shingles >> np.uint64(64 - (self.s.bins - 1).bit_length())).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        low = np.zeros(self.s.bins, np.uint64)
        low[own[first]] = 1 + mixed(shingles[first]) % np.uint64((1 << self.s.bits) - 1)
        planes = (low.reshape(-1, 1, 64) >> np.arange(self.s.bits, dtype=np.uint64)[:, None]) & np.uint64(1)
        return np.bitwise_or.reduce(planes << np.arange(64, dtype=np.uint64), axis=2).reshape(-1).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text: str, s: Settings) -> DataFrame:
    """``id``, ``n_shingles``, ``set_key`` (null for an empty set), ``sig`` and ``bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(s)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n, keys, sigs, bands = [], [], [], []
                for t in batch.column(1):
                    x = hasher.shingles(t.as_py())
                    n.append(len(x))
                    keys.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                    low = hasher.minima(x) if len(x) else None
                    sigs.append(hasher.packed(x) if len(x) else None)
                    bands.append(hasher.bands(low) if len(x) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                    names=["id", "n_shingles", "set_key", "sig", "bands"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), text).mapInArrow(run, "id long, n_shingles long, set_key binary, sig array<long>, bands array<long>")


def shingle_sets(docs: DataFrame, id_col: str, text: str, s: Settings) -> DataFrame:
    """``id`` and the sorted distinct shingle hashes ``shingles`` as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(s)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                sets = [hasher.shingles(t.as_py()).tobytes() for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text).mapInArrow(run, "id long, shingles binary")


def texts_of(docs: DataFrame, id_col: str, text: str, ids: DataFrame) -> DataFrame:
    """``_id`` and the text of each of ``ids`` (``id``, once each). Only texts that may be asked for are shuffled."""
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text)
    return sifted(texts, "_id", ids, "id").join(ids, F.col("_id") == F.col("id"), "left_semi").dropDuplicates(["_id"])


def planes(column: pa.Array, s: Settings) -> np.ndarray:
    """Signatures by row, word of 64 bins, and bit."""
    return matrix(column, s.planes).view(np.uint64).reshape(len(column), s.bins // 64, s.bits)


def alike(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray, s: Settings) -> np.ndarray:
    """Whether classes of ``n`` and ``m`` shingles with signatures ``x`` and ``y``, broadcast against each other, may be similar enough.

    Of ``used`` bins that either fills, ``equal`` agree; of the ``both`` that both
    fill, the share ``chance`` of those that don't come from one shingle agrees as
    well. The bins are a sample without replacement of the union, whose size the
    two set sizes give at the threshold.
    """
    used = both = equal = np.int64(0)
    for w in range(s.bins // 64):
        fill_x = fill_y = differ = np.uint64(0)
        for p in range(s.bits):
            a, b = x[..., w, p], y[..., w, p]
            fill_x, fill_y, differ = fill_x | a, fill_y | b, differ | (a ^ b)
        shared = fill_x & fill_y
        used = used + np.bitwise_count(fill_x | fill_y)
        both = both + np.bitwise_count(shared)
        equal = equal + np.bitwise_count(shared & ~differ)
    at, chance = s.percent / 100, 1 / ((1 << s.bits) - 1)
    used = np.maximum(used, 1)
    rest = np.maximum(1 - used * (1 + at) / (n + m), 0)
    floor = at - s.margin * np.sqrt(at * (1 - at) / used * rest) - s.slack
    return (100 * np.minimum(n, m) >= s.percent * np.maximum(n, m)) & ((equal - chance * both) / (1 - chance) / used >= floor)


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text: str, s: Settings) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full shingle sets are similar enough."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = written(shingle_sets(texts_of(docs, id_col, text, need), "_id", text, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            keep = []
            for x, y in zip(whole.column(2), whole.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)) if len(x) else 0
                keep.append(100 * both >= s.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([whole.column(0), whole.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    y = x.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    found = written(y.mapInArrow(run, "a long, b long"))
    dropped(sets)
    return found


def placed_in(buckets: DataFrame, parts: DataFrame | None, more: list[str]) -> DataFrame:
    """(``key``, ``id``, ``component``, ...): a class that has no link yet is its own component."""
    if parts is None:
        return buckets.select("key", "id", F.col("id").alias("component"), *more)
    known = parts.select(F.col("node").alias("_node"), "component")
    return buckets.join(known, F.col("id") == F.col("_node"), "left").select("key", "id", F.coalesce("component", "id").alias("component"), *more)


def open_keys(placed: DataFrame, *more: Column) -> DataFrame:
    """Buckets that hold more than one component."""
    found = placed.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), *more)
    return found.where("_lo < _hi").drop("_lo", "_hi")


def estimated(pairs: DataFrame, heads: DataFrame, s: Settings) -> DataFrame:
    """Those of ``pairs`` (a, b, low) that may be similar enough by their signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                keep = alike(b.column("xn").to_numpy(), planes(b.column("xs"), s), b.column("yn").to_numpy(), planes(b.column("ys"), s), s)
                yield b.select(["a", "b", "low"]).filter(pa.array(keep))

    x = heads.select(F.col("id").alias("a"), F.col("n").alias("xn"), F.col("sig").alias("xs"))
    y = heads.select(F.col("id").alias("b"), F.col("n").alias("yn"), F.col("sig").alias("ys"))
    both = pairs.join(x, "a").join(y, "b").where(100 * F.least("xn", "yn") >= s.percent * F.greatest("xn", "yn"))
    return both.select("a", "b", "low", "xn", "xs", "yn", "ys").mapInArrow(run, pairs.select("a", "b", "low").schema)


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The runs of rows that agree in ``keys``, from batches sorted by them; a run may span batches."""
    rest = None
    for b in batches:
        t = b if rest is None else pa.concat_batches([rest, b])
        if not t.num_rows:
            continue
        values = [t.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.logical_or.reduce([v[1:] != v[:-1] for v in values])
        starts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for at, end in zip(starts, starts[1:], strict=False):
            yield t.slice(at, end - at)
        rest = t.slice(starts[-1])
    if rest is not None:
        yield rest


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def candidates(g: pa.RecordBatch, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a bucket's two blocks (or one with itself) that are of different components, may be similar enough by :func:`alike`'s rule, and weren't ``tried``.

    A pair belongs to the first bucket that it shares.
    """
    own, i, j = (g.column(c).to_numpy() for c in ("own", "i", "j"))
    left, right = np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0])
    sig, n, component = planes(g.column("sig"), s), g.column("n").to_numpy(), g.column("component").to_numpy()
    near = alike(n[left][:, None], sig[left][:, None], n[right][None], sig[right][None], s)
    near &= component[left][:, None] != component[right][None]
    if i[0] == j[0]:
        near = np.triu(near, 1)
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    bands = matrix(g.column("bands"), s.bands)
    first = (bands[a] == bands[b]).argmax(1)
    mine = bands[a, first] == g.column("key")[0].as_py()
    a, b = a[mine], b[mine]
    tried = [frozenset(x or ()) for x in g.column("tried").to_pylist()]
    if any(tried):
        ids = g.column("id").to_pylist()
        new = [k for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)) if ids[y] not in tried[x] and ids[x] not in tried[y]]
        a, b = a[new], b[new]
    return a, b


def within_buckets(open_: DataFrame, docs: DataFrame, id_col: str, text: str, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between components within buckets, and the rows that were looked at for them.

    ``open_`` has a row per class and bucket, with the bucket's ``size`` and the
    classes that it has been ``tried`` with. A bucket
    is divided into blocks of about ``block`` classes, and two blocks at a time
    meet in one task, so that a class costs a row for each block, never for each
    partner. First by signatures alone, which leaves the classes that have a
    candidate; their full sets then follow, and of each two blocks come only
    links that join components, fewer than classes.
    """
    n = F.ceil(F.col("size") / s.block)
    own = F.pmod(F.xxhash64("id"), n).alias("own")
    rows = open_.select("key", "id", "component", "n", "sig", "bands", "tried", own, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("other"))
    keys = ("key", "i", "j")
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", "n", "sig", "bands", "tried")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*keys)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, keys):
            if g.num_rows > 1:
                keep = np.unique(np.concatenate(candidates(g, s)))
                if len(keep):
                    yield g.take(pa.array(keep))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, keys):
            ids, component = g.column("id").to_numpy(), g.column("component").to_pylist()
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.get(x, x) != x:
                    x = root[x]
                return x

            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in g.column("shingles")]
            found = []
            for a, b in zip(*candidates(g, s), strict=True):
                p, q = find(component[a]), find(component[b])
                if p == q:
                    continue
                x, y = sorted((sets[a], sets[b]), key=len)
                common = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
                if 100 * common >= s.percent * (len(x) + len(y) - common):
                    root[max(p, q)] = min(p, q)
                    found.append(sorted((int(ids[a]), int(ids[b]))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    some = written(dealt(rows).mapInArrow(sift, rows.schema))
    sets = written(shingle_sets(texts_of(docs, id_col, text, some.select("id").distinct()), "_id", text, s))
    return dealt(some.join(sets, "id").select(*rows.columns, "shingles")).mapInArrow(confirm, "a long, b long"), some


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` and ``kept`` for each row of ``docs``.

    Ids are integers. Null and empty texts have no shingles and are linked with
    nothing. Rows that share an id share its first class; a row without an id
    is never linked, keeps a null component and is kept. Columns other than id
    and text aren't read. An empty table gives an empty result.
    """
    sigs = written(signatures(docs, id_col, text, s))
    known = sigs.where("set_key is not null and id is not null")
    classes = written(known.groupBy("set_key").agg(F.min("id").alias("class"), F.count("*").alias("n")))
    # A set that much of all documents have is joined by broadcast.
    member = split_join(known.select("id", "set_key"), classes, ["set_key"], "n", sigs.count())
    member = written(member.groupBy("id").agg(F.min("class").alias("class")))
    heads = known.join(member.where("id = class").select("id"), "id", "left_semi").dropDuplicates(["id"])
    heads = written(heads.select("id", F.col("n_shingles").alias("n"), "bands", "sig"))
    sizes = written(sigs.select("id", "n_shingles"))
    dropped(sigs, classes)
    slots = heads.select("id", F.explode("bands").alias("key"))
    full = slots.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = written(slots.join(full, "key"))
    degree = buckets.groupBy("id").agg(F.sum("size").alias("degree"))
    ranked = written(buckets.select("key", "id").join(degree, "id"))
    dropped(buckets)

    none = heads.sparkSession.createDataFrame([], "a long, b long")
    links, tried, parts = none, none.withColumn("low", F.lit(None).cast("boolean")), None
    for k in range(s.rounds):
        placed = placed_in(ranked, parts, ["degree"])
        # Later centres come from the smallest component, most often the largest in the bucket: only what is outside it is paired.
        order = F.struct("degree", "id") if k == 0 else F.struct(-F.col("component"), F.xxhash64(F.lit(k), "id"), "id")
        centre = open_keys(placed, F.max_by(F.struct("id", "component"), order).alias("c"))
        stars = placed.join(centre, "key").where(F.col("component") != F.col("c.component")).select(F.col("id").alias("x"), F.col("c.id").alias("y"))
        # ``low``: the smaller id is that of the class, not of the centre.
        stars = stars.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max(F.col("x") < F.col("y")).alias("low"))
        if k:
            stars = stars.join(tried, ["a", "b"], "left_anti")
        close = written(estimated(stars, heads, s))
        found = confirmed(close, docs, id_col, text, s)
        tried = tried.unionByName(close) if k else close
        links = links.unionByName(found) if k else found
        parts = written(components(links))

    placed = placed_in(ranked, parts, [])
    open_ = written(placed.join(open_keys(placed, F.count("*").alias("size")), "key"))
    open_ = open_.join(sifted(heads, "id", open_, "id"), "id")
    # A class has at most one centre in a bucket and round, so that its list has a bound; a centre's would have none.
    own, other = F.when(F.col("low"), F.col("a")).otherwise(F.col("b")), F.when(F.col("low"), F.col("b")).otherwise(F.col("a"))
    open_ = open_.join(tried.groupBy(own.alias("id")).agg(F.collect_set(other).alias("tried")), "id", "left")
    more, _ = within_buckets(open_, docs, id_col, text, s)
    more = written(more)
    dropped(ranked, heads)
    joined = components(links.unionByName(more))
    found = member.join(joined, member["class"] == joined["node"], "left").select(F.col("id").alias("_id"), F.coalesce("component", "class").alias("component_id"))
    out = sizes.join(found, F.col("id") == F.col("_id"), "left")
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
