"""Shards of nearly equal bytes: histogram sort, from DataFrame functions alone.

Rows have a place on a line: a digest of their content, then of their id, then
of a row number, so that equal contents are neighbours, a group of copies of any
size can be cut between two of them, and even repeats of one row can.

1. Probes are candidate boundaries on that line. A round counts the exact bytes
   between neighbouring probes over all partitions: at first 1024 probes over
   the whole line, then 1024 within each interval that holds a boundary which
   isn't near enough to its goal. At most ``1024 * shards`` sums reach the
   driver in a round, whatever the number of rows. After the first round only
   rows within those intervals are counted.
2. A boundary is settled when one end of its interval is within ``tolerance`` of
   the goal (``j / shards`` of all bytes), or when the interval holds one row.
   Then it is the nearer end.
3. A row's shard is the number of boundaries not above it, an expression with
   literals. Rows are exchanged once, for their slots: each shard is divided
   into ``blocks`` by the digest of the id; a slot is what lies in lower blocks
   plus the place within its own, so that no task holds a whole shard.

So a shard is off its goal by at most twice the tolerance or the largest row,
whichever is more. The same rows get the same shards in any file layout; of
rows that are equal in content and id, which one gets which of their slots is of
no consequence. Null contents and ids count as empty; an empty table gives an
empty result; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import written

#: A key is three numbers of WIDTH bits; a round refines by BITS of them.
WIDTH, BITS = 60, 10
KEYS = ("_shard_k0", "_shard_k1", "_shard_k2")
SIZE, SHARD, BLOCK = "_shard_size", "_shard_of", "_shard_block"


@dataclass(frozen=True)
class Settings:
    """``tolerance`` of a boundary in millionths of a shard; ``blocks`` of a shard, a power of two up to 1024."""

    shards: int = 40
    tolerance: int = 1000
    blocks: int = 64


def place(value: Column) -> Column:
    """The first 60 bits of a value's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, WIDTH // 4), 16, 10).cast("long")


@dataclass(frozen=True)
class Interval:
    """``prefix``: the digits that its keys begin with, as one number of ``level`` digits; ``below``: bytes of lower keys."""

    level: int
    prefix: int
    below: int

    def parts(self) -> list[int]:
        """The prefix as its numbers: whole ones, then the bits of the last."""
        bits, out = self.level * BITS, []
        while bits > 0:
            own = min(bits, WIDTH)
            out.append((self.prefix >> (bits - own)) & ((1 << own) - 1))
            bits -= own
        return out


def cut_columns(level: int) -> list[Column]:
    """The first ``level`` digits of a row's key, as :meth:`Interval.parts` has them."""
    bits = level * BITS
    whole, rest = divmod(bits, WIDTH)
    return [F.col(k) for k in KEYS[:whole]] + ([F.shiftright(KEYS[whole], WIDTH - rest)] if rest else [])


def inside(interval: Interval) -> Column:
    out = F.lit(True)
    for c, v in zip(cut_columns(interval.level), interval.parts(), strict=True):
        out = out & (c == F.lit(v))
    return out


def boundaries(rows: DataFrame, s: Settings) -> list[tuple[int, int, int]]:
    """The least key of each shard but the first, ascending."""
    total = rows.agg(F.sum(SIZE)).first()[0] or 0
    open_ = {Interval(0, 0, 0): list(range(1, s.shards))} if total else {}
    found: dict[int, int] = {}
    last = len(KEYS) * WIDTH // BITS
    for level in range(1, last + 1):
        if not open_:
            break
        some = rows
        if level > 1:
            within = F.lit(False)
            for i in open_:
                within = within | inside(i)
            some = rows.where(within)
        cut = cut_columns(level)
        names = [f"c{k}" for k in range(len(cut))]
        sums: dict[int, list[tuple[int, int, int]]] = {}
        for r in some.groupBy(*[c.alias(x) for c, x in zip(cut, names, strict=True)]).agg(F.sum(SIZE).alias("bytes"), F.count("*").alias("n")).collect():
            p = 0
            for k, x in enumerate(names):
                own = WIDTH if k < len(names) - 1 else level * BITS - k * WIDTH
                p = p << own | r[x]
            sums.setdefault(p >> BITS, []).append((p, r["bytes"], r["n"]))
        refined: dict[Interval, list[int]] = {}
        for i, goals in open_.items():
            probes, upto = sorted(sums[i.prefix]), []
            at = i.below
            for _, size, _ in probes:
                at += size
                upto.append(at)
            for j in goals:
                k = bisect_left(upto, -(-j * total // s.shards))  # the first that reaches the goal
                p, size, n = probes[k]
                before, after = j * total - (upto[k] - size) * s.shards, upto[k] * s.shards - j * total
                if n == 1 or level == last or min(before, after) * 1_000_000 <= s.tolerance * total:
                    found[j] = (p if before <= after else p + 1) << (WIDTH * len(KEYS) - level * BITS)
                else:
                    refined.setdefault(Interval(level, p, upto[k] - size), []).append(j)
        open_ = refined
    low = (1 << WIDTH) - 1
    return [(found[j] >> 2 * WIDTH, found[j] >> WIDTH & low, found[j] & low) for j in sorted(found)]


def shard_of(bounds: list[tuple[int, int, int]]) -> Column:
    """The number of boundaries that a row's key isn't below, by halving."""

    def reached(b: tuple[int, int, int]) -> Column:
        k0, k1, k2 = (F.col(k) for k in KEYS)
        later = (k1 > b[1]) | ((k1 == b[1]) & (k2 >= b[2])) if b[2] else (k1 >= b[1])
        return (k0 > b[0]) | ((k0 == b[0]) & later) if b[1] or b[2] else k0 >= b[0]

    def halve(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(reached(bounds[mid]), halve(mid + 1, high)).otherwise(halve(low, mid))

    return halve(0, len(bounds))


def sharded_at(df: DataFrame, place0: Column, place1: Column, size: Column, s: Settings = Settings()) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: rows in shards of nearly equal sums of ``size`` (positive), slots gapless from 0.

    ``place0`` and ``place1`` are the places of a row's content and id, see
    :func:`place`. Columns of ``df`` named ``shard`` or ``slot`` give way.
    """
    mine = [c for c in df.columns if c not in ("shard", "slot")]
    number = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND((1 << WIDTH) - 1)
    rows = written(df.select(*mine, place0.alias(KEYS[0]), place1.alias(KEYS[1]), number.alias(KEYS[2]), size.cast("long").alias(SIZE)))
    block = F.shiftright(KEYS[1], WIDTH - (s.blocks - 1).bit_length())
    rows = rows.withColumns({SHARD: shard_of(boundaries(rows, s)), BLOCK: block})
    own = Window.partitionBy(SHARD).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    # One row per block of a shard: shards times blocks at most, so the broadcast has a bound.
    base = rows.groupBy(SHARD, BLOCK).count().select(SHARD, BLOCK, F.coalesce(F.sum("count").over(own), F.lit(0)).alias("_shard_base"))
    within = F.row_number().over(Window.partitionBy(SHARD, BLOCK).orderBy(*KEYS))
    return rows.join(F.broadcast(base), [SHARD, BLOCK]).select(*mine, F.col(SHARD).cast("int").alias("shard"), (F.col("_shard_base") + within - 1).cast("long").alias("slot"))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text and 16 of its row's frame."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def shard_documents(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Documents, all columns, in shards of nearly equal bytes; copies of one text lie side by side but where a boundary cuts them."""
    return sharded_at(docs, place(F.col("text")), place(F.col("doc_id")), text_bytes(F.col("text")), s)
