"""Line dedup: lines that equal an earlier line, or are within a few edits of one.

Segment-partition edit join: a line is split into ``edits + 1`` segments; a line
within ``edits`` edits of it holds one of them unchanged, at a place that the
two lengths narrow down. An index row for each segment, keyed by the line's
length, the segment's number and its text, meets a probe row for each substring
that a line of the same or greater length may share with it. A line's index
rows are among its own probes, so that one set of rows is shuffled for both.

A line's key holds a hash and, in its low bits, the parity of its characters'
counts in ``PARITY`` classes: an edit flips two of these bits at most. One sort
by bucket drops the rows that are alone in theirs, and semi joins those that meet
no other line of fitting parities, so that no pair is ever a row. Each bucket is then sorted by the lines' first
places, and a line is held against the earlier ones, with a banded bit-parallel
edit distance where the sketches of both allow it, until one witness is found.
A line gives one row for each of its buckets, however many lines are near it.

Equal lines fold into one row per worker share before any shuffle and into one
class after it, so that a line in a third of all documents is no large group.
Large buckets are dealt out in blocks of ``block`` lines, a task for each two
blocks. Lines that make up much of all places are joined by broadcast: there
are at most ``HEAVY`` of them, whatever the data.

Decisions: of each class all places but the first go; if any earlier class is
within the edits, the first goes too. Lines of fewer than ``shortest``
characters are held against equal ones only; lines without a word stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import split_join, written

#: Classes of characters whose count parities a line's key holds.
PARITY = 24
#: Lines that a worker remembers to have indexed.
SEEN = 500_000
#: Keys with more than this share of all rows are heavy: there can't be more of them.
HEAVY = 10_000


@dataclass(frozen=True)
class Settings:
    """``shortest``: lines of fewer characters go only where they equal an earlier one.
    ``broadcast``: up to so many keys of lines to verify are sent to every worker; more of them are joined.
    ``block``: lines of a bucket that one task holds at a time, twice."""

    edits: int = 2
    shortest: int = 20
    broadcast: int = 200_000
    block: int = 2048


#: White space that normalising would change, within a text between line ends.
ODD = (b"  ", b"\t", b"\x0b", b"\x0c", b"\r", b" \n", b"\n ")


def normal(line: bytes) -> str:
    """A-Z lower-cased, white space collapsed and trimmed."""
    return b" ".join(line.lower().split()).decode("utf-8", "surrogatepass")


#: The parity bit of a character's class, by the low byte of its code point; a line end has none.
BIT = np.where(np.arange(256) == 10, 0, 1 << (np.arange(256) % PARITY)).astype(np.int64)


def packed(line: str) -> bytes:
    """Latin-1 if it holds the characters, else UTF-32: one form for equal strings, and quick to cut and hash."""
    try:
        return line.encode("latin-1")
    except UnicodeEncodeError:
        return line.encode("utf-32-le", "surrogatepass")


def keyed(data: bytes, parity: int) -> int:
    """``64 - PARITY`` bits of hash above the parities of the characters' counts, as a signed long."""
    key = xxhash.xxh3_64_intdigest(data) >> PARITY << PARITY | parity
    return key - (1 << 64) if key >> 63 else key


def line_keys(text: str | None, shortest: int) -> tuple[list[tuple[int, bytes | str, int]], int]:
    """(number, normalised line, key) of the lines that are long enough, and the number of lines.

    Lines come as bytes in Latin-1, or as strings where that doesn't hold them.
    """
    if not text:
        return [], 0
    data = text.encode("utf-8", "surrogatepass").lower()
    if any(x in data for x in ODD) or data[:1] == b" " or data[-1:] == b" ":
        data = b"\n".join(b" ".join(x.split()) for x in data.split(b"\n"))
    whole = data.decode("utf-8", "surrogatepass")
    try:
        data = whole.encode("latin-1")
    except UnicodeEncodeError:
        found = []
        lines = whole.split("\n")
        for k, line in enumerate(lines):
            if len(line) >= shortest:
                low = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint8)[::4]
                own = packed(line)
                found.append((k, own if len(own) == len(line) else line, keyed(own, int(np.bitwise_xor.reduce(BIT[low])))))
        return found, len(lines)
    lines = data.split(b"\n")
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    # Each line reaches to the next one's start; one more element stands for an empty last line.
    bits = BIT[np.frombuffer(data + b"\n", np.uint8)]
    parity = np.bitwise_xor.reduceat(bits, np.cumsum(sizes + 1) - sizes - 1).tolist()
    return [(k, line, keyed(line, p)) for k, (line, p) in enumerate(zip(lines, parity, strict=True)) if len(line) >= shortest], len(lines)


def segments(n: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of the ``edits + 1`` segments of a line of ``n`` characters; the last ones are the longer."""
    k = edits + 1
    sizes = [n // k + (i >= k - n % k) for i in range(k)]
    starts = np.cumsum([0, *sizes[:-1]]).tolist()
    return list(zip(starts, sizes, strict=True))


def probes(n: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, size) of the substrings of a line of ``n`` characters to look up.

    Of all places these suffice: a shift by the edits before a segment, or by
    those after it, whichever bounds more.
    """
    out = []
    for m in range(max(1, n - edits), n + 1):
        d = n - m
        for i, (start, size) in enumerate(segments(m, edits)):
            low = max(0, start - i, start + d - (edits - i))
            high = min(n - size, start + i, start + d + (edits - i))
            out += [(m, i, at, size) for at in range(low, high + 1)]
    return out


def bounded_distance(a: str, b: str, most: int) -> int:
    """The edit distance, or ``most + 1`` if it is greater.

    Bit-parallel, in a band of ``2 * most + 1`` diagonals: bit ``d`` of the
    ``e``-th mask tells that prefixes of ``a`` and ``b`` on diagonal ``d`` can be
    matched with ``e`` edits; a common prefix and suffix cost nothing.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    low = len(commonprefix((a, b)))
    a, b = a[low:], b[low:]
    tail = len(commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    width = 2 * most + 1
    full = (1 << width) - 1
    # masks[e] after i characters of a: bit d is set if a[:i] and b[:i + d - most] are within e edits.
    masks = [sum(1 << d for d in range(width) if 0 <= d - most <= e) for e in range(most + 1)]
    for i, x in enumerate(a):
        equal = 0
        for d in range(width):
            j = i + d - most
            if 0 <= j < len(b) and b[j] == x:
                equal |= 1 << d
        inside = full
        for d in range(width):
            if i + 1 + d - most < 0 or i + 1 + d - most > len(b):
                inside &= ~(1 << d)
        new = []
        for e in range(most + 1):
            m = masks[e] & equal
            if e:
                m |= masks[e - 1] | (masks[e - 1] >> 1)  # replaced; taken out of a
                m |= new[e - 1] << 1  # put into a
            new.append(m & inside & full)
        if not new[most]:
            return most + 1
        masks = new
    goal = len(b) - len(a) + most
    return next((e for e in range(most + 1) if masks[e] >> goal & 1), most + 1)


def map_lines(docs: DataFrame, each, schema: str, names: list[str], types: list) -> DataFrame:
    """``each()`` gives a function that appends to columns what a document (id, text) yields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = each()
        for whole in batches:
            for at in range(0, whole.num_rows, 300):
                cols: list[list] = [[] for _ in names]
                for i, t in zip(*(c.to_pylist() for c in whole.slice(at, 300).columns), strict=True):
                    state(cols, i, t)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names=names)

    return docs.mapInArrow(run, schema)


def places(docs: DataFrame, s: Settings) -> DataFrame:
    """(``line``, ``doc``, ``number``) of each line with a word, and a row of (null, doc, number of lines)."""

    def each():
        def state(cols: list, i, t) -> None:
            found, n = line_keys(t, 1)
            cols[0] += [None, *(x[2] for x in found)]
            cols[1] += [i] * (len(found) + 1)
            cols[2] += [n, *(x[0] for x in found)]

        return state

    return map_lines(docs, each, "line long, doc long, number int", ["line", "doc", "number"], [pa.int64(), pa.int64(), pa.int32()])


def entries(docs: DataFrame, s: Settings) -> DataFrame:
    """(``key``, ``line``, ``own``): the probe rows of each distinct line of a worker's share; ``own`` ones are its index rows too."""

    def each():
        seen, plans, digest = set(), {}, xxhash.xxh3_64_intdigest

        def plan_of(n: int) -> tuple[list[tuple[int, int, int]], list[bool]]:
            if len(plans) > 10_000:
                plans.clear()
            own = {(n, i, a) for i, (a, _) in enumerate(segments(n, s.edits))}
            each = probes(n, s.edits)
            plans[n] = [(m * 8 + i, a, a + size) for m, i, a, size in each], [(m, i, a) in own for m, i, a, _ in each]
            return plans[n]

        def state(cols: list, _, t) -> None:
            for _, line, key in line_keys(t, s.shortest)[0]:
                if key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                plan, own = plans.get(len(line)) or plan_of(len(line))
                if isinstance(line, bytes):
                    cols[0] += [digest(line[x:y], seed) >> 1 for seed, x, y in plan]
                else:  # a piece of it may be Latin-1 and must then hash as one
                    cols[0] += [digest(packed(line[x:y]), seed) >> 1 for seed, x, y in plan]
                cols[1] += [key] * len(plan)
                cols[2] += own

        return state

    return map_lines(docs, each, "key long, line long, own boolean", ["key", "line", "own"], [pa.int64(), pa.int64(), pa.bool_()])


def texts_of(docs: DataFrame, need: DataFrame, where: DataFrame, s: Settings) -> DataFrame:
    """(``line``, ``text``) of the lines in ``need``; if they are few, only the first document of each is read again."""

    def each():
        done = set()

        def state(cols: list, _, t) -> None:
            for _, line, key in line_keys(t, s.shortest)[0]:
                if key not in done:
                    if len(done) >= SEEN:
                        done.clear()
                    done.add(key)
                    cols[0].append(key)
                    cols[1].append(line.decode("latin-1") if isinstance(line, bytes) else line)

        return state

    if few := need.limit(s.broadcast + 1).count() <= s.broadcast:
        homes = written(where.join(F.broadcast(need), "line").groupBy("line").agg(F.min("doc").alias("home")).select("home").distinct())
        docs = docs.join(F.broadcast(homes), docs["id"].eqNullSafe(homes["home"]), "left_semi")
    found = map_lines(docs, each, "line long, text string", ["line", "text"], [pa.int64(), pa.string()])
    return found.join(F.broadcast(need) if few else need, "line", "left_semi").groupBy("line").agg(F.min("text").alias("text"))


def met_lines(docs: DataFrame, s: Settings) -> DataFrame:
    """(``key``, ``line``) of the index rows and the probes of other lines, of fitting parities, that meet."""
    bucket = Window.partitionBy("key")
    each = entries(docs, s).withColumns({"low": F.min("line").over(bucket), "high": F.max("line").over(bucket), "held": F.max("own").over(bucket)})
    each = written(each.where("held and low <> high").select("key", "line", "own").distinct())
    x, y = each.where("own").select("key", "line"), each.select(F.col("key").alias("_key"), F.col("line").alias("_line"))
    bits = F.bit_count(F.col("line").bitwiseXOR(F.col("_line")).bitwiseAND(F.lit((1 << PARITY) - 1)))
    meet = (F.col("key") == F.col("_key")) & (F.col("line") != F.col("_line")) & (bits <= 2 * s.edits)
    probe = y.join(x, meet, "left_semi").select(F.col("_key").alias("key"), F.col("_line").alias("line"))
    return x.join(y, meet, "left_semi").unionByName(probe).distinct()


def sketch(line: str) -> int:
    """Parities of the counts of the pairs of neighbouring characters, in 64 classes; an edit flips four at most."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    own = (c[:-1] * np.uint64(0x9E3779B1) + c[1:] * np.uint64(0x85EBCA77)) >> np.uint64(13) & np.uint64(63)
    return int(np.bitwise_xor.reduce(np.uint64(1) << own)) if len(own) else 0


def witnessed(bucket: list[dict], edits: int) -> list[int]:
    """Those lines of a bucket, given by their first places, that have an earlier one within the edits.

    Lines of one block, where the bucket has two, aren't held against each other.
    """
    keys = np.array([r["line"] for r in bucket], np.int64) & ((1 << PARITY) - 1)
    marks = np.array([sketch(r["text"]) for r in bucket], np.uint64)
    block = np.array([r["block"] for r in bucket])
    size = np.array([len(r["text"]) for r in bucket])
    one = len(set(block.tolist())) == 1
    out = []
    for j in range(1, len(bucket)):
        differ = np.bitwise_count(marks[:j] ^ marks[j])
        fits = (np.bitwise_count(keys[:j] ^ keys[j]) <= 2 * edits) & (differ <= 4 * edits) & (abs(size[:j] - size[j]) <= edits)
        if not one:
            fits &= block[:j] != block[j]
        may = np.flatnonzero(fits)
        if any(bounded_distance(bucket[i]["text"], bucket[j]["text"], edits) <= edits for i in may[np.argsort(differ[may], kind="stable")].tolist()):
            out.append(bucket[j]["line"])
    return out


def near_lines(docs: DataFrame, where: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """``line`` of the distinct lines that have an earlier one within the edits."""
    met = written(met_lines(docs, s))
    need = written(met.select("line").distinct())
    known = texts_of(docs, need, where, s).join(classes.select("line", "first"), "line")
    # More lines than the second bound: there are few such buckets, whatever the data.
    small = max(1, s.block // 8)
    n = F.col("count")
    parts = F.greatest(F.ceil(n / s.block), F.least(F.ceil(n / small), F.lit(16))).cast("int").alias("parts")
    parts = met.groupBy("key").count().where(n > max(small, met.count() // HEAVY)).select("key", parts)
    rows = met.join(known, "line").join(F.broadcast(parts), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("line"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "line", "first", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(bucket: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(witnessed(bucket, s.edits), pa.int64())], names=["line"])

        bucket, own = [], None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                for r in batch.slice(at, 1000).to_pylist():
                    if own != (now := (r["key"], r["x"], r["y"])):
                        if len(bucket) > 1:
                            yield told(bucket)
                        bucket, own = [], now
                    bucket.append(r)
        if len(bucket) > 1:
            yield told(bucket)

    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "first").select("key", "x", "y", "block", "line", "text").mapInArrow(run, "line long").distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """``id_col``, ``n_lines``, ``n_removed`` and ``removed`` (numbers from 0), a row for each id.

    Ids are integers and order the documents, a null id before all others; rows
    with one id must be repeats of one row and count once. A null or empty text
    has no lines. Lines without a word are never removed, those of fewer than
    ``shortest`` characters only for an equal one. Columns other than id and
    text aren't read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    where = written(places(own, s).distinct())
    at = F.struct(F.coalesce("doc", F.lit(-(1 << 63))).alias("doc"), "number")
    classes = written(where.where("line is not null").groupBy("line").agg(F.min(at).alias("first"), F.count("*").alias("n")))
    later = near_lines(own, where, classes, s).withColumn("near", F.lit(True))
    touched = written(classes.join(later, "line", "left").where("n > 1 or near").select("line", "n", "first", F.coalesce("near", F.lit(False)).alias("near")))
    each = split_join(where, touched, ["line"], "n", where.count())
    each = each.withColumn("gone", F.col("first").isNotNull() & (F.col("near") | (at != F.col("first"))))
    n = F.max(F.when(F.col("line").isNull(), F.col("number"))).cast("long")
    out = each.groupBy("doc").agg(n.alias("n_lines"), F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("number")))).alias("removed"))
    return out.select(F.col("doc").alias(id_col), "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", s: Settings = Settings(), drop_empty: bool = True) -> DataFrame:
    """``docs`` less the repeated lines of ``text``; with ``drop_empty``, less the rows that this leaves without a word.

    Rows that had no word before stay as they are.
    """
    gone = repeated_lines(docs, id_col, text, s).where("n_removed > 0").select(F.col(id_col).alias("_q_id"), F.col("removed").alias("_q_removed"))
    both = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("_q_id")), "left")
    lines = F.split(text, "\n")
    # A map from line number to flag would be scanned for each line; lines and numbers are merged by position instead.
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_q_removed"))
    left = F.array_join(F.transform(keep, lambda k: F.get(lines, k)), "\n")
    out = both.withColumn("_q_left", F.when(F.col("_q_removed").isNotNull(), left)).drop("_q_removed", "_q_id")
    if drop_empty:
        out = out.where(F.col("_q_left").isNull() | F.col("_q_left").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn(text, F.coalesce("_q_left", text)).select(docs.columns)
