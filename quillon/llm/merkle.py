"""Merkle manifest of a dataset: a tree of digests per group, a root over the groups, a proof per row.

A row's leaf is a digest of its columns; leaves of a group ascend by id, and
every ``fanout`` consecutive nodes become one until one is left.

1. Ranks without a global sort: the id's digits make bins, a row's rank in its
   group is what lies in lower bins plus its place within its own. Bins are
   counted once, then digit by digit from the top (:func:`offsets`), so that no
   window holds more than ``base`` counts. A bin that a repeated id makes large
   is divided by the leaf's digits, equal leaves by a row number's
   (:func:`binned`).
2. A node is keyed by its rank's digits to the base ``fanout``. Nodes that share
   all but the last digits, ``depth`` of them, meet in one task and are reduced
   to the node of their longest common prefix; the prefixes are the next stage's
   nodes. A group of any size is many bounded blocks, and 10^12 rows are five
   stages.
3. Down again: each block gets the path from its node to the root, adds its own
   siblings, and hands the longer paths to the stage below.

Digests are computed in the JVM for leaves and with ``hashlib`` in Arrow batches
of blocks for nodes. Each stage is a table in the shared folder.

Nulls: a null column counts as ``-``; a null group is a group of its own, the
first; rows with a null id come first in theirs. Rows that repeat an id are
ordered by their leaves; equal rows are leaves each, and which of them gets
which of their ranks is of no consequence but for the proof, one each. An empty
table has no rows and no root. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Digits of ids and leaves are to the base 2**BITS.
BITS = 12


def leaf(columns: dict[str, Column]) -> Column:
    """SHA-256, as bytes, of each column's length in bytes, a colon and its value; ``-`` for a null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns.values()]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame, group: str = "lang") -> DataFrame:
    """(``g``, ``doc_id``, ``leaf``, ``forged``, ``tie``): ``g`` orders groups bytewise, null first; ``forged`` where tampering strikes."""
    own = {c: F.col(c) for c in COLUMNS}
    struck = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf(own).alias("leaf"),
        F.when(struck, leaf(own | {"n_chars": F.col("n_chars") + 1})).alias("forged"), F.xxhash64(F.monotonically_increasing_id()).alias("tie"),
    )


def digits_below(leaf: Column, tie: Column) -> list[Column]:
    """What divides the rows of one id: four digits of the leaf, then four of the row number's hash."""
    of_leaf = [F.conv(F.substring(F.hex(leaf), 1 + 3 * k, 3), 16, 10).cast("long") for k in range(4)]
    return of_leaf + [F.shiftrightunsigned(tie, BITS * k).bitwiseAND((1 << BITS) - 1) for k in range(4)]


def binned(rows: DataFrame, most: int) -> DataFrame:
    """Adds ``top``, the id without its last digit, and ``bin``, digits that tell bins of at most ``most`` rows apart.

    Only ids that repeat make a ``top`` larger than ``2**BITS``. Those bins alone
    go on to the next digit, in rounds that end when none is too large.
    """
    own = F.coalesce(F.col("doc_id"), F.lit(0))
    rows = rows.withColumns({"top": F.shiftright(own, BITS), "null_id": F.col("doc_id").isNull(), "bin": F.array().cast("array<bigint>")})
    for digit in [own.bitwiseAND((1 << BITS) - 1), *digits_below(F.col("leaf"), F.col("tie"))]:
        large = rows.groupBy("g", "null_id", "top", "bin").count().where(F.col("count") > most).drop("count")
        if large.isEmpty():
            break
        large = large.withColumn("large", F.lit(True))
        rows = rows.join(large, ["g", "null_id", "top", "bin"], "left").withColumn("bin", F.when(F.col("large"), F.concat("bin", F.array(digit))).otherwise(F.col("bin"))).drop("large")
        rows = written(rows)
    return rows


def offsets(bins: DataFrame) -> DataFrame:
    """``below``: how many rows of the group lie in lower bins than (``null_id``, ``top``, ``bin``); ``bins`` carries ``count``.

    Counts go up by the digits of ``top`` until one more digit holds all, and
    the sums of what lies before go down again.
    """
    lower = lambda *keys, order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda w: F.coalesce(F.sum("count").over(w), F.lit(0))
    level = bins.groupBy("g", "null_id", "top").agg(F.sum("count").alias("count"))
    span = level.agg(F.min("top").alias("low"), F.max("top").alias("high")).first()
    levels, shift = [level], 0
    while span.low is not None and (span.high >> shift) - (span.low >> shift) >= 1 << BITS:
        shift += BITS
        level = level.groupBy("g", "null_id", F.shiftright("top", BITS).alias("top")).agg(F.sum("count").alias("count"))
        levels.append(level)
    # Null ids come first, so that all others follow their number.
    down = levels[-1].withColumn("below", before(lower("g", order=[F.desc("null_id"), "top"]))).drop("count")
    for level in reversed(levels[:-1]):
        up = down.select("g", "null_id", F.col("top").alias("parent"), F.col("below").alias("base"))
        own = level.withColumn("parent", F.shiftright("top", BITS))
        own = own.withColumn("inner", before(lower("g", "null_id", "parent", order=["top"])))
        down = own.join(up, ["g", "null_id", "parent"]).select("g", "null_id", "top", (F.col("base") + F.col("inner")).alias("below"))
    inner = bins.withColumn("inner", before(lower("g", "null_id", "top", order=["bin"])))
    return inner.join(down, ["g", "null_id", "top"]).select("g", "null_id", "top", "bin", (F.col("below") + F.col("inner")).alias("below"))


def ranked(rows: DataFrame, most: int = 1 << 16) -> DataFrame:
    """(``g``, ``rank``, ``doc_id``, ``leaf``, ``forged``): ``rank`` counts from 0 within the group, by id, then leaf."""
    rows = binned(rows, most)
    keys = ["g", "null_id", "top", "bin"]
    w = Window.partitionBy(*keys).orderBy("doc_id", "leaf", "tie")
    found = rows.join(offsets(rows.groupBy(*keys).count()), keys)
    return found.select("g", (F.col("below") + F.row_number().over(w) - 1).alias("rank"), "doc_id", "leaf", "forged")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes: list[str], height: int, fanout: int) -> list[list[str]]:
    """The nodes and all levels over them, ``height`` of them."""
    levels = [nodes]
    for _ in range(height):
        levels.append([digest(*levels[-1][k : k + fanout]) for k in range(0, len(levels[-1]), fanout)])
    return levels


def siblings(levels: list[list[str]], at: int, fanout: int) -> list[str]:
    """For each level, what stands left and right of the node's ancestor in its run, as ``left|right``."""
    out = []
    for level in levels[:-1]:
        start = at - at % fanout
        out.append("".join(level[start:at]) + "|" + "".join(level[at + 1 : start + fanout]))
        at //= fanout
    return out


def folded(node: str, path: list[str]) -> str:
    for step in path:
        left, right = step.split("|")
        node = digest(left, node, right)
    return node


def height_of(n: int, block: int, fanout: int) -> int:
    """Levels from a block's nodes to its root: all of the block's where the group has more than it, else those that leave one node."""
    n, k = min(n, block), 0
    while fanout**k < n:
        k += 1
    return k


def blocks(nodes: DataFrame, block: int) -> DataFrame:
    """One row per ``block`` consecutive nodes of a group: (``g``, ``block``, ``members``, ``n``), written; ``n`` counts the group."""
    more = [c for c in nodes.columns if c != "g"]  # ``rank`` is the first
    own = nodes.groupBy("g", F.floor(F.col("rank") / block).cast("long").alias("block")).agg(F.sort_array(F.collect_list(F.struct(*more))).alias("members"))
    own = written(own)
    return own.join(own.groupBy("g").agg(F.sum(F.size("members")).alias("n")), "g")


def up(stage: DataFrame, name: str, block: int, fanout: int) -> DataFrame:
    """(``g``, ``rank``, ``node``): each block reduced to its node."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roots = [tree([x.hex() for x in nodes.as_py()], height_of(n.as_py(), block, fanout), fanout)[-1][0] for nodes, n in zip(b["nodes"], b["n"], strict=True)]
            yield pa.RecordBatch.from_arrays([b["g"], b["block"], pa.array([bytes.fromhex(x) for x in roots], pa.binary())], names=["g", "rank", "node"])

    return stage.select("g", "block", "n", F.col(f"members.{name}").alias("nodes")).mapInArrow(reduce, "g string, rank long, node binary")


def climb(nodes: DataFrame, name: str, block: int, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The stages of blocks, the lowest first, and (``g``, ``rank``, ``node``) of each group's root."""
    stages = []
    while True:
        stages.append(blocks(nodes, block))
        nodes, name = written(up(stages[-1], name, block, fanout)), "node"
        if nodes.where("rank > 0").isEmpty():
            return stages, nodes


def down(stage: DataFrame, paths: DataFrame, block: int, fanout: int) -> DataFrame:
    """(``g``, ``block``, ``path``) of the stage below, from those of this one: each node's siblings before its block's path."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, nodes, first, n, path in zip(b["g"], b["nodes"], b["first"], b["n"], b["path"], strict=True):
                nodes, first, path = [x.hex() for x in nodes.as_py()], first.as_py(), path.as_py()
                levels = tree(nodes, height_of(n.as_py(), block, fanout), fanout)
                own = [siblings(levels, k, fanout) + path for k in range(len(nodes))]
                yield pa.RecordBatch.from_arrays([pa.array([g.as_py()] * len(own), pa.string()), pa.array(range(first, first + len(own)), pa.int64()), pa.array(own, pa.list_(pa.string()))], names=["g", "block", "path"])

    both = stage.join(paths, ["g", "block"]).select("g", F.col("members.node").alias("nodes"), (F.col("block") * block).alias("first"), "n", "path")
    return both.mapInArrow(extend, "g string, block long, path array<string>")


PROVED = "doc_id long, leaf string, path array<string>, proof_sha256 string, folded_root string, subroot string"


def proved(stage: DataFrame, paths: DataFrame, roots: DataFrame, block: int, fanout: int, keep_path: bool) -> DataFrame:
    """Rows of the first stage, their siblings' digest, and the root that their leaf, tampered or not, folds to."""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for members, n, rest, subroot in zip(b["members"], b["n"], b["path"], b["subroot"], strict=True):
                members, rest = members.as_py(), rest.as_py()
                levels = tree([m["leaf"].hex() for m in members], height_of(n.as_py(), block, fanout), fanout)
                tail = "".join(rest).replace("|", "")
                above: dict[str, str] = {}  # what the block's path makes of each node that its leaves fold to
                out = []
                for k, m in enumerate(members):
                    own = siblings(levels, k, fanout)
                    node = folded((m["leaf"] if m["forged"] is None else m["forged"]).hex(), own)
                    if node not in above:
                        above[node] = folded(node, rest)
                    out.append((m["doc_id"], levels[0][k], own + rest if keep_path else None, digest("".join(own).replace("|", ""), tail), above[node], subroot.as_py()))
                kinds = (pa.int64(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "leaf", "path", "proof_sha256", "folded_root", "subroot"])

    both = stage.join(paths, ["g", "block"]).join(roots, "g").select("members", "n", "path", "subroot")
    return both.mapInArrow(prove, PROVED)


def manifest(docs: DataFrame, group: str = "lang", fanout: int = 2, depth: int = 8, most: int = 1 << 16, keep_path: bool = False) -> DataFrame:
    """(``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``, and ``path`` if kept) per row.

    ``path`` is the proof itself: for each level what stands left and right of
    the node in its run. ``folded_root`` is recomputed from the leaf, that of a
    tampered row where tampering strikes, and is checked against the root.
    ``depth`` levels of the tree make a block; ``most`` rows a bin of ids.
    """
    block = fanout**depth
    stages, roots = climb(ranked(written(leaves(docs, group)), most), "leaf", block, fanout)
    # The groups are the leaves of one more tree: a row each, so that one task numbers them.
    order = roots.select(F.lit("").alias("g"), (F.row_number().over(Window.partitionBy(F.lit("")).orderBy("g")) - 1).cast("long").alias("rank"), "node", F.col("g").alias("of"))
    order = written(order)
    tops, root = climb(order.select("g", "rank", "node"), "node", block, fanout)
    paths = root.select("g", F.col("rank").alias("block"), F.array().cast("array<string>").alias("path"))
    for stage in reversed(tops):
        paths = down(stage, paths, block, fanout)
    paths = order.join(paths.select(F.col("block").alias("rank"), "path"), "rank").select(F.col("of").alias("g"), F.lit(0).cast("long").alias("block"), "path")
    for stage in reversed(stages[1:]):
        paths = down(stage, paths, block, fanout)
    whole = root.first()
    out = proved(stages[0], paths, roots.select("g", F.lower(F.hex("node")).alias("subroot")), block, fanout, keep_path)
    out = out.withColumn("root", F.lit(whole.node.hex() if whole else None).cast("string"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *(["path"] if keep_path else []))
