"""Manifest, conversation repair and shards: brute force, edge cases, and the paths for hot keys."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm import conversation_repair, merkle, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, g string, rank long, bin long, shard string, slot string, size long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, n, "x", 1, 2, "a", "b", 3) for i, t, lang, n in rows], DOCS)


def nulls_first(row):
    return tuple((x is not None, x) for x in row)


# --- manifest ---------------------------------------------------------------------


def joined_hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest_of(rows, fanout):
    """By definition: whole levels per group, and a walk up for each row."""

    def leaf(i, t, lang, n):
        return joined_hash(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, None, lang, n, t)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([joined_hash(*out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
        return out

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    trees = {g: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for g, own in groups.items()}
    trees = {g: (own, levels([leaf(*r) for r in own])) for g, own in trees.items()}
    names = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    top = levels([trees[g][1][-1][0] for g in names])
    out = []
    for at_top, g in enumerate(names):
        own, tree = trees[g]
        for k, (i, t, lang, n) in enumerate(own):
            forged = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
            node, beside = leaf(i, t, lang, n + forged if n is not None else None), []
            for lv, at in ((tree, k), (top, at_top)):
                for level in lv[:-1]:
                    start = at - at % fanout
                    left, right = level[start:at], level[at + 1 : start + fanout]
                    beside += left + right
                    node = joined_hash(*left, node, *right)
                    at //= fanout
            out.append((i, tree[0][k], tree[-1][0], top[-1][0], joined_hash(*beside), node, node == top[-1][0]))
    return sorted(out, key=nulls_first)


EDGE_DOCS = [(5, "a", None, 1), (5, "a", None, 1), (5, "b", None, 1), (None, "c", None, 2), (None, "a", None, None), (-7, "é漢😀", "", 3), (2**60, None, "é", 3), (-(2**60), "x" * 200_000, "é", 3), (0, None, "é", None), (3, "", "zz", 0)]
EDGE_DOCS += [(9, "z", "hot", 1)] * 23 + [(k % 3, str(k), "hot", 1) for k in range(20)] + [(k * 4000, str(k), "wide", 7) for k in range(30)]


@pytest.mark.parametrize(("fanout", "depth", "most"), [(2, 8, 1 << 16), (2, 2, 4), (3, 1, 3)])
def test_manifest_by_definition(spark, fanout, depth, most):
    """Nulls, repeats, long and empty texts, ids at both ends; small blocks and bins force all stages."""
    got = merkle.manifest(docs(spark, EDGE_DOCS), fanout=fanout, depth=depth, most=most)
    assert sorted(map(tuple, got.collect()), key=nulls_first) == manifest_of(EDGE_DOCS, fanout)


def test_manifest_paths_prove_their_leaves(spark):
    rows = merkle.manifest(docs(spark, EDGE_DOCS), depth=2, keep_path=True).collect()
    for r in rows:
        assert merkle.folded(r.leaf, r.path) == r.root
        assert joined_hash("".join(r.path).replace("|", "")) == r.proof_sha256


def test_manifest_of_one_row_and_none(spark):
    (r,) = merkle.manifest(docs(spark, [(1, "t", "en", 1)])).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == hashlib.sha256().hexdigest()
    assert merkle.manifest(docs(spark, [])).collect() == []


# --- conversations ------------------------------------------------------------------

NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
FULL = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(key.encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        out += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.strip(" \t\n\x0b\x0c\r")[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
        seen.add((role, text))
    return out


def all_edits(rows, found, inserts):
    """Every sequence of edits with at most so many inserts: (cost, letters, result)."""

    def go(i, state, left):
        if i == len(rows) and state in ("", "a"):
            yield 0, "", ()
        if left:
            for x, to in NEXT[state].items():
                if x in FULL:
                    for c, e, o in go(i, to, left - 1):
                        yield c + 5, "I" + e, ((FULL[x], ""), *o)
        if i < len(rows):
            _, role, text = rows[i]
            for c, e, o in go(i + 1, state, left):
                yield c + 2, "D" + e, o
            if found[i] not in ("blank", "duplicate"):
                more = 5 * (found[i] == "truncated")
                if role[:1] and role[:1] in NEXT[state]:
                    for c, e, o in go(i + 1, NEXT[state][role[:1]], left):
                        yield c + more, "K" + e, ((role, text), *o)
                for x, to in NEXT[state].items():
                    if x in FULL:
                        for c, e, o in go(i + 1, to, left):
                            yield c + more + 1, "R" + e, ((FULL[x], text), *o)

    return go(0, "", inserts)


def repaired_by_listing(rows):
    out = []
    for conv, own in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), lambda r: r[0]):
        there = damage(list(own))
        found = faults(there)
        cost, edits, result = min(all_edits(there, found, 3))
        turns = {t for t, _, _ in there} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        wrong = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(there))
        text = "\n".join(f"{r}:{t}" for r, t in result)
        out.append((conv, gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), wrong, cost, edits, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=nulls_first)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "conv_id long, turn long, role string, text string, g string, piece int, digest string")


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "assistant", "user", "system", "tool", "", None], ["a.", "b!", "c", " \t", "", None, "x? \n", "é漢.", "y" * 100_000]
    return [(conv, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for conv in (*range(40), None) for _ in range(rng.randint(1, 6))]


@pytest.mark.parametrize("most_rows", [100_000, 3, 1])
def test_repairs_against_all_edits(spark, talks, most_rows):
    """Whole conversations in tasks, some in pieces, all in pieces: one result, that of listing every sequence of edits."""
    got = conversation_repair.repaired(conversations(spark, talks), conversation_repair.Settings(most_rows=most_rows))
    assert sorted(map(tuple, got.collect()), key=nulls_first) == repaired_by_listing(talks)


def test_one_large_conversation_in_pieces(spark):
    rows = [(7, t // 2, ("user", "assistant")[t % 2], f"text {t // 3}" + "." * (t % 11 > 0)) for t in range(3000)] + [(7, 5, "user", "same.")] * 2000 + [(8, 0, "user", "a."), (8, 1, "assistant", "b.")]
    df = conversations(spark, rows)
    whole = {r.conv_id: r for r in conversation_repair.repaired(df).collect()}
    pieces = {r.conv_id: r for r in conversation_repair.repaired(df, conversation_repair.Settings(most_rows=400)).collect()}
    assert whole == pieces and set(whole) == {7, 8}
    assert conversation_repair.repaired(df.limit(0)).collect() == []


# --- shards -------------------------------------------------------------------------


def test_shards_by_definition(spark, sf_dir):
    """Bytes are near their goals, slots gapless, copies side by side, other columns untouched."""
    rng = random.Random(3)
    rows = [(k, "w" * rng.randint(0, 300), "en", k) for k in range(3000)] + [(None, None, None, None)] * 4
    s = sharding.Settings(shards=7, tolerance=1000, blocks=4)
    df = docs(spark, rows)
    out = sharding.shard_documents(df, s)
    assert out.columns == [c for c in df.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    got = out.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=nulls_first) == sorted((r[:2] for r in rows), key=nulls_first)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r.shard] += len(r.text or "") + 16
        slots[r.shard].append(r.slot)
    mean = sum(sizes.values()) / 7
    assert set(sizes) == set(range(7)) and all(abs(x - mean) <= max(316, mean * 0.002) for x in sizes.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    cut = defaultdict(set)
    for r in got:
        cut[r.text].add(r.shard)
    assert sum(len(x) - 1 for x in cut.values()) <= 6


def test_shards_cut_copies_and_repeats(spark):
    """A third of the rows has one text, a third is one row."""
    rows = [(1, "same", "en", 4)] * 300 + [(k, "copy", "en", 4) for k in range(300)] + [(k, f"t{k:03d}", "en", 4) for k in range(300)]
    got = sharding.shard_documents(docs(spark, rows), sharding.Settings(shards=9, tolerance=0)).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == pytest.approx([100] * 9, abs=1)
    assert sharding.shard_documents(docs(spark, [])).collect() == []
    (r,) = sharding.shard_documents(docs(spark, [(1, "x" * 100_000, "en", 1)])).collect()
    assert r.slot == 0 and 0 <= r.shard < 40


def test_shards_do_not_depend_on_the_layout(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = (sharding.shard_documents(x).select("doc_id", "shard", "slot") for x in (d, d.repartition(13, F.rand(1))))
    assert sorted(a.collect()) == sorted(b.collect())


def test_sharding_is_native(spark, sf_dir):
    from quillon.llm import queries

    plan = queries.op13_sharding(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
