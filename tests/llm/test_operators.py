"""The training-data operators against brute force on small fixtures, with their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontaminate, license_scan, line_dedup, mix_sources, near_dedup, quality_classifier, quality_rules, queries, secret_scan, substring_dedup, url_filters
from quillon.llm.common import sifted
from quillon.llm.components import components
from tests.compare import assert_same

#: The last columns have names that operators use within.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, key string, id long, line string, lost string, n_words long, size long"


def docs(spark, texts, ids=None, source="s"):
    rows = [(i, t, "en", source, len(t or ""), "x", "y", 7, "z", "l", 3, 4) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def vocabulary(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


EDGES = [None, "", " \n\t ", "one", "one", "two words", "x" * 5000, "Aé ß 漢字 😀 İ", "a\r\nb\x0bc\x1cd\x85e\xa0f", "line\n\nline\n"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir)


# --- near-duplicates --------------------------------------------------------------


def exact_components(texts, size):
    sets = {}
    for i, t in texts.items():
        w = words_of(t)
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    rng, vocab = random.Random(size), vocabulary()
    texts = list(EDGES)
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 40, 150]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([1, 3, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy).upper() if g % 3 == 0 else " ".join(copy))
    got = near_dedup.near_duplicates(docs(spark, texts), s=near_dedup.Settings(size=size)).collect()
    expected, sizes = exact_components(dict(enumerate(texts)), size)
    assert {r.doc_id: r.component_id for r in got} == expected
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_a_chain_and_of_repeated_rows(spark):
    """Neighbours are similar, ends aren't; a row given twice stays twice; a row without an id is kept."""
    vocab = [f"w{k}" for k in range(260)]
    texts = [" ".join(vocab[10 * k : 10 * k + 160]) for k in range(10)]
    got = near_dedup.near_duplicates(docs(spark, texts, ids=range(10)).unionByName(docs(spark, [texts[0], "lonely row"], ids=[0, None]))).collect()
    assert {r.component_id for r in got if r.doc_id is not None} == {0}
    assert sorted((r.doc_id, r.kept) for r in got if r.doc_id == 0) == [(0, True), (0, True)]
    assert [r.kept for r in got if r.doc_id is None] == [True]


def template_texts(n):
    """Texts that share 401 words and have 59 of their own: 400 of 520 two-word shingles, similarity 0.77."""
    shared = [f"t{k}" for k in range(401)]
    return [" ".join(shared + [f"d{i}w{k}" for k in range(59)]) for i in range(n)]


def bucket_rows(spark, texts, s, monkeypatch):
    seen = []
    inner = near_dedup.within_buckets

    def counted(*args):
        links, some = inner(*args)
        seen.append((some.count(), links.count()))
        return links, some

    monkeypatch.setattr(near_dedup, "within_buckets", counted)
    got = near_dedup.near_duplicates(docs(spark, texts), s=s).collect()
    monkeypatch.undo()
    return got, *seen[0]


@pytest.mark.parametrize("block", [256, 40])
def test_groups_just_below_the_limit_make_no_pairs_as_rows(spark, monkeypatch, block):
    """300 texts of which each two are at 0.77: none linked, and at most a row per band, block and text."""
    s = near_dedup.Settings(size=2, block=block)
    got, rows, links = bucket_rows(spark, template_texts(300), s, monkeypatch)
    assert all(r.kept and r.component_id == r.doc_id for r in got) and links == 0
    assert rows <= 300 * s.bands * -(-300 // block)


def test_links_within_buckets_equal_those_of_all_pairs(spark):
    """Without stars, and with small blocks, the buckets alone find all components."""
    texts = template_texts(30) + [" ".join([f"t{k}" for k in range(401)] + [f"e{i // 3}w{k}" for k in range(50)] + [f"f{i}"]) for i in range(60)]
    rng = random.Random(8)
    rng.shuffle(texts)
    for s in (near_dedup.Settings(size=2, block=7), near_dedup.Settings(size=2, rounds=1, block=16)):
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, texts), s=s).collect()}
        assert got == exact_components(dict(enumerate(texts)), 2)[0]


def test_components_of_long_paths(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (7, 7), (500, 500)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 103: 100, 500: 500}


def test_sifted_keeps_all_wanted_rows_and_few_others(spark):
    rows = spark.range(200_000).withColumn("key", F.when(F.col("id") % 1000 != 0, F.col("id")))
    wanted = spark.range(0, 200_000, 37)
    got = {r.key for r in sifted(rows, "key", wanted, "id").select("key").collect()}
    assert got >= {k for k in range(0, 200_000, 37) if k % 1000} and None not in got
    assert len(got) < 5406 + 400


def test_near_duplicates_shuffle_no_text_that_is_not_asked_for(spark, monkeypatch):
    """Without broadcasts, as at size: of 400 texts, two of which are alike, hardly a text of the others comes to the join."""
    rng, vocab = random.Random(5), vocabulary(4000)
    texts = [" ".join(rng.choice(vocab) for _ in range(60)) for _ in range(400)]
    texts[7] = texts[300] + " more"
    seen, inner = [], near_dedup.sifted

    def counted(df, *args):
        out = inner(df, *args)
        seen.append((df.columns[0], out.count()))
        return out

    monkeypatch.setattr(near_dedup, "sifted", counted)
    got = near_dedup.near_duplicates(docs(spark, texts), s=near_dedup.Settings(size=2)).collect()
    assert {r.doc_id for r in got if not r.kept} == {300}
    shuffled = [n for c, n in seen if c == "_id"]
    assert shuffled and max(shuffled) < 40


# --- decontamination --------------------------------------------------------------


def test_leaks(spark):
    rng, vocab = random.Random(3), vocabulary()
    item = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [item(30), item(60), item(3), None, "", " "]
    changed = items[1].split()
    changed[30] = "changed"
    far = items[0].split()[:12]
    filler = item(200)
    texts = [*EDGES, filler, f"{filler}\n{items[0].upper()} {filler}", f"{filler} {' '.join(changed)}", f"{filler} {' '.join(far)} {filler}", items[2], f"x {items[2]} y", items[0].replace(" ", "\n")]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    n = len(EDGES)
    for s in (decontaminate.Settings(), decontaminate.Settings(share_words=25)):
        got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs(spark, texts), bench, s=s).collect()}
        assert set(got) == {(n + 1, 0), (n + 2, 1), (n + 4, 2), (n + 5, 2), (n + 6, 0)}
        assert (got[n + 1, 0].similarity, got[n + 1, 0].first_word, got[n + 1, 0].n_words) == (1.0, 200, 30)
        assert 0.8 <= got[n + 2, 1].similarity < 1
    left = decontaminate.without_leaks(docs(spark, texts), bench)
    assert left.columns == docs(spark, []).columns
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - {n + 1, n + 2, n + 4, n + 5, n + 6}
    assert decontaminate.leaks(docs(spark, texts), bench.limit(0)).count() == 0


def test_leaks_of_documents_shorter_than_the_item(spark):
    """Against the exact similarity of the whole document: items that lost their first or last words."""
    rng, vocab = random.Random(4), vocabulary()
    items = [[rng.choice(vocab) for _ in range(n)] for n in (60, 60, 25, 9, 5, 4)]
    texts = [w[:-k] for w in items for k in (1, 3, 4, 11, 12, 13, 30) if k < len(w)] + [w[3:] for w in items] + [["changed", *items[0][1:-2]], items[1][:50] + items[0][:9]]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    expected = {}
    for i, t in enumerate(texts):
        for j, w in enumerate(items):
            size = min(5, len(w))
            a, b = ([tuple(x[k : k + size]) for k in range(len(x) - size + 1)] for x in (t, w))
            score = sum(min(a.count(x), b.count(x)) for x in {*a, *b}) / sum(max(a.count(x), b.count(x)) for x in {*a, *b})
            if score >= 0.8:
                expected[i, j] = (score, 0, len(t))
    joined = docs(spark, [" ".join(t) for t in texts])
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.n_words) for r in decontaminate.leaks(joined, bench).collect()}
    assert got == expected
    assert expected[1, 0] == (53 / 56, 0, 57)
    assert {r.doc_id for r in decontaminate.without_leaks(joined, bench).collect()} == set(range(len(texts))) - {i for i, _ in expected}


@pytest.mark.parametrize("items", [50, 900])
def test_multi_index_misses_no_fingerprint_within_the_radius(items):
    """Both ways of probing; the index passes few unrelated pairs."""
    import numpy as np

    rng, vocab = np.random.default_rng(5), vocabulary()
    s = decontaminate.Settings()
    index = decontaminate.Index([(k, " ".join(rng.choice(vocab, 20))) for k in range(items)], s)
    fps = rng.integers(0, 1 << 63, 300, np.uint64) * np.uint64(2) + rng.integers(0, 2, 300, np.uint64)
    for k in range(0, 300, 3):  # near ones
        bits = rng.choice(64, int(rng.integers(0, 20)), replace=False)
        fps[k] = index.fps[k % items] ^ np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64), initial=np.uint64(0))
    tables = index.lengths[20][1]
    w, item = index.candidates(tables, fps)
    near = np.bitwise_count(fps[:, None] ^ index.fps[None, :]) <= s.radius
    assert set(zip(w.tolist(), item.tolist(), strict=True)) == set(zip(*map(list, np.nonzero(near)), strict=True))
    far = np.delete(fps, np.s_[::3])
    probed = sum(int(tables[k][2][index.probed(tables[k][0], index.block(far, k))[1]].sum()) for k in range(decontaminate.BLOCKS))
    assert probed < 0.05 * len(far) * items


def weighted(a, b, size):
    """Weighted Jaccard similarity of the shingles of two word lists, by counting."""
    x, y = (Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) for w in (a, b))
    return sum((x & y).values()) / sum((x | y).values())


def test_leaks_recall_against_brute_force(spark):
    """All windows of all documents against all items: what is found is exact, and hardly anything isn't found."""
    rng, vocab = random.Random(14), vocabulary(150)
    items = [[rng.choice(vocab) for _ in range(rng.choice([20, 30, 60]))] for _ in range(12)]
    texts = []
    for _ in range(90):
        w = list(rng.choice(items))
        for _ in range(rng.choice([0, 1, 1, 2])):
            k, at = rng.random(), rng.randrange(len(w))
            if k < 0.5:
                w[at] = rng.choice(vocab)
            elif k < 0.75:
                del w[at]
            else:
                w.insert(at, rng.choice(vocab))
        texts.append([rng.choice(vocab) for _ in range(rng.randrange(40))] + w + [rng.choice(vocab) for _ in range(rng.randrange(40))])
    expected = {}
    for i, t in enumerate(texts):
        for j, w in enumerate(items):
            n = min(len(w), len(t))
            best = max(weighted(t[k : k + n], w, 5) for k in range(len(t) - n + 1))
            if best >= 0.8:
                expected[i, j] = best
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs(spark, [" ".join(t) for t in texts]), bench).collect()}
    assert set(got) <= set(expected) and len(expected) > 40
    assert all(got[k] == pytest.approx(expected[k]) for k in got)
    assert len(got) >= 0.97 * len(expected)


def test_leaks_of_repeated_and_null_rows_and_of_a_very_long_text(spark):
    rng, vocab = random.Random(15), vocabulary()
    item = " ".join(rng.choice(vocab) for _ in range(25))
    long = " ".join(rng.choice(vocab) for _ in range(120_000))
    bench = spark.createDataFrame([(1, item), (1, item), (None, item + " more words here")], "item_id long, text string")
    table = docs(spark, [item, item, f"{long} {item} {long}", None], ids=[4, 4, 5, None]).unionByName(docs(spark, [item], ids=[None]))
    got = sorted((r.doc_id or 0, r.item_id or 0, r.first_word) for r in decontaminate.leaks(table, bench).where("item_id is not null").collect())
    assert got == [(0, 1, 0)] * 2 + [(4, 1, 0)] * 4 + [(5, 1, 120_000)] * 2
    assert decontaminate.without_leaks(table, bench).collect()[0].text is None


# --- url filters ------------------------------------------------------------------


def brute_rule(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in rules if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def test_url_filters_equal_brute_force(spark):
    rng = random.Random(7)
    labels, parts = ["com", "net", "a", "b", "ab", "a-b", "ex"], ["", "/", "/x", "/x/", "/xy", "/é/", "/x/y", "/ÿ"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = list({(h, p): (rng.choice(["block", "allow"]), h, p) for h, p in ((host(), rng.choice(parts)) for _ in range(60))}.values())
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{host().upper() if rng.random() < 0.2 else host()}{rng.choice(parts)}{rng.choice(parts)}{rng.choice(['', '?q=/x', '#/x'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "://", "http://", "http://.com", "http://a..com/x", "http://com:80/", "x://y://a.com/x", "http://com/\n/x", urls[0], urls[0]]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    table = url_filters.rules_table(spark, [*rules, ("block", "", "/"), ("block", "com", None)])
    for n in (1, 5):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(pages, table, parts=n).collect()}
        assert got == {k: brute_rule(u, rules) for k, u in enumerate(urls)}
    twice = url_filters.filter_urls(pages.limit(3).withColumn("page_id", F.lit(None).cast("long")), table)
    assert twice.count() == 3
    assert url_filters.filter_urls(pages.limit(0), table).count() == 0
    assert url_filters.filter_urls(pages, table.limit(0)).where("rule is not null").count() == 0


def test_url_filters_run_no_python(spark, sf_dir):
    for name in ("op3_url_filters", "op6_secret_scan", "op9_quality_rules"):
        plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


# --- classifier -------------------------------------------------------------------


def test_classifier_learns_and_ignores_all_but_the_text(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.op4_quality_classifier(spark, sf_dir)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    pairs = [(a > b) + (a == b) / 2 for a, x in held if x for b, y in held if not y]
    assert sum(pairs) / len(pairs) > 0.9


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, None), (None, 1)], "doc_id long, quality int")
    texts = [("good plain words here" if k % 2 else "### $$$ %%% &&&") for k in range(40)] + EDGES
    got = quality_classifier.classify(docs(spark, texts).unionByName(docs(spark, ["no id"], ids=[None])), labels).collect()
    assert len(got) == len(texts) + 1
    assert all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert quality_classifier.classify(docs(spark, EDGES), labels.limit(0)).count() == len(EDGES)
    assert quality_classifier.classify(docs(spark, []), labels).count() == 0


# --- mixing -----------------------------------------------------------------------


def test_training_rows_are_drawn_after_the_length_bound(spark):
    """Half the labelled texts are too long, and a third of the rows repeat: still as many rows as asked for, all short."""
    s = quality_classifier.Settings(sample_rows=300, sample_chars=100)
    texts = ["short text" if k % 2 else "x " * 500 for k in range(1400)]
    table = docs(spark, texts).unionByName(docs(spark, texts[:700]))
    labels = spark.createDataFrame([(k, k % 3 % 2) for k in range(1400)], "doc_id long, quality int")
    rows = quality_classifier.sample(table, labels, "doc_id", "text", "quality", s)
    assert len(rows) == 300 and all(len(t) <= 100 for t, _ in rows)


def test_mixing_hits_the_target_weights(spark):
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"), F.lit(5).alias("copy"))
    out = mix_sources.mix(many, {"a": 3.0, "b": 1.0})
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert n["a"] / (n["a"] + n["b"]) == pytest.approx(0.75, abs=0.02)
    assert n[None] == pytest.approx(2000, abs=150)  # natural share
    again = mix_sources.mix(many.repartition(7), {"a": 3.0, "b": 1.0})
    assert sorted(map(str, out.select("doc_id", "copy").collect())) == sorted(map(str, again.select("doc_id", "copy").collect()))
    assert [r.doc_id for r in out.limit(50).collect()] != sorted(r.doc_id for r in out.limit(50).collect())


def test_poisson_moments(spark):
    for rate in (0.3, 4.0, 90.0):
        x = spark.range(4000).select(mix_sources.poisson(F.lit(rate), 1, F.col("id")).alias("n")).agg(F.avg("n"), F.var_samp("n")).first()
        assert x[0] == pytest.approx(rate, rel=0.08)
        assert x[1] == pytest.approx(rate, rel=0.12)


def test_mixing_edges(spark):
    out = mix_sources.mix(docs(spark, EDGES, source=None), {"s": 1.0})
    assert [*docs(spark, []).columns, "copy"] == out.columns
    out.collect()
    assert mix_sources.mix(docs(spark, []), {"s": 1.0}).count() == 0
    assert mix_sources.mix(docs(spark, [None, ""]), {"s": 1.0}).count() == 0
    mix_sources.mix(docs(spark, EDGES), {}).collect()


# --- secrets ----------------------------------------------------------------------


def test_secret_forest_on_findings_it_has_not_seen(spark):
    model = secret_scan.train(secret_scan.labelled_findings(spark))
    hex40 = hashlib.sha1(b"x").hexdigest()
    texts = [f'set token = "{hex40}" now', f"see commit {hex40} for it", "a thunderouslylongishword here", None, "", "x" * 4000, f'token = "{hex40}" and token = "{hex40}"', f"é {hex40}"]
    got = secret_scan.scan(docs(spark, texts), model).collect()
    flat = {i: [m.start() for m in re.finditer(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}", t)] for i, t in enumerate(texts) if t}
    assert {i: sorted(r.start for r in got if r.doc_id == i) for i in flat if flat[i]} == {i: x for i, x in flat.items() if x}
    verdict = {r.doc_id: r.secret for r in got}
    assert verdict[0] and verdict[6] and not verdict[1] and not verdict[2] and not verdict[5]
    assert all(r.sha256 == hashlib.sha256(hex40.encode()).hexdigest() for r in got if r.doc_id in (0, 1))
    assert secret_scan.scan(docs(spark, []), model).count() == 0
    unseen = secret_scan.with_features(secret_scan.labelled_findings(spark, 1500, 77))
    from pyspark.ml.feature import VectorAssembler

    judged = model.transform(VectorAssembler(inputCols=list(secret_scan.FEATURES), outputCol="features").transform(unseen))
    assert judged.where("label = prediction").count() / judged.count() > 0.97


def test_secret_candidates_and_their_context_equal_brute_force(spark):
    rng = random.Random(6)
    bits = ["aws_secret_access_key", "=", "==", " = ", '"', " ", "\n", "é", ": ", "a1" * 8, "B" * 14, "C" * 15, "d/+-" * 20, "======", "=======", "?token=", "x", "e" * 10, "----------------", "=" * 20]
    texts = [*EDGES, *["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(150)], "F" * 14 + "==", "G" * 13 + "==", "H" * 20 + "==,"]
    expected = set()
    for i, t in enumerate(texts):
        for m in re.finditer(r"(?<![A-Za-z0-9_+/-])([A-Za-z0-9_+/-]+)(={1,6}(?![A-Za-z0-9_+/=-]))?", t or ""):
            if len(m[0]) >= 16:
                expected.add((i, m.start(), m[0], t[max(0, m.start() - 48) : m.start()], t[m.end() : m.end() + 24]))
    got = secret_scan.candidates(docs(spark, texts)).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_secrets_under_long_names_and_without_quotes(spark):
    model = secret_scan.train(secret_scan.labelled_findings(spark))
    value = hashlib.sha1(b"y").hexdigest()
    texts = [f'aws_secret_access_key = "{value}"', f"aws_secret_access_key={value}", f"API_KEY={value}", f"password={value}\n", f"credential={value} and", f"sha256:{value}"]
    got = {(r.doc_id, r.start): r for r in secret_scan.scan(docs(spark, texts), model).collect()}
    own = [got[k, t.index(value)] for k, t in enumerate(texts)]
    assert [r.secret for r in own] == [True] * 5 + [False]
    assert all(r.length == 40 and r.sha256 == hashlib.sha256(value.encode()).hexdigest() for r in own)
    assert not any(r.secret for (_, start), r in got.items() if start == 0)


def test_very_long_texts_with_many_hits(spark):
    """100,000 words, every fifth a candidate or the start of a phrase: places as a plain search finds them."""
    key = "Ab1" * 6
    text = " ".join([f"token {key} cc by license"] * 20_000)
    got = secret_scan.candidates(docs(spark, [text])).agg(F.count("*"), F.min("start"), F.max("start"), F.sum("start")).first()
    step = len(f"token {key} cc by license ")
    assert tuple(got) == (20_000, 6, 6 + 19_999 * step, sum(6 + k * step for k in range(20_000)))
    r = license_scan.scan(docs(spark, [text])).drop("spans").first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (100_000, 20_000, 2, 99_997)


def test_the_context_s_checkpoint_folder_serves_where_the_session_names_none(spark, tmp_path, monkeypatch):
    from quillon.llm import common
    from quillon.sources import sinks

    monkeypatch.setattr(type(spark.conf), "get", lambda _, key, default=None: default)
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda _: f"file://{tmp_path}/shared")
    assert common.checkpoint_root(spark) == sinks.shared_folder(spark) == f"file://{tmp_path}/shared"
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda _: None)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:7077")
    for root in (common.checkpoint_root, sinks.shared_folder):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            root(spark)


# --- lines ------------------------------------------------------------------------


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, n, alphabet="abé"):
    x = list(s)
    for _ in range(n):
        k, at = rng.random(), rng.randrange(len(x) + 1)
        if k < 0.4 and at < len(x):
            x[at] = rng.choice(alphabet)
        elif k < 0.7 and at < len(x) and len(x) > 1:
            del x[at]
        else:
            x.insert(at, rng.choice(alphabet))
    return "".join(x)


def test_bounded_distance_and_probes_are_complete():
    rng = random.Random(2)
    for _ in range(4000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))
        b = edited(rng, a, rng.randint(0, 4), "ab") if a else "ab"
        assert line_dedup.bounded_distance(a, b, 2) == min(3, edit_distance(a, b))
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(3, 30)))
        b = edited(rng, a, 2, "abc")
        a, b = sorted((a, b), key=len)
        if len(a) >= 3:
            index = {(len(a), i, a[p : p + z]) for i, (p, z) in enumerate(line_dedup.segments(len(a), 2))}
            assert index & {(m, i, b[p : p + z]) for m, i, p, z in line_dedup.probes(len(b), 2)}


@pytest.mark.parametrize(("broadcast", "block"), [(500_000, 2048), (0, 3)])
def test_line_dedup_equals_brute_force(spark, broadcast, block):
    rng = random.Random(9)
    lines = ["".join(rng.choice("abcdefgh é€") for _ in range(rng.randint(15, 60))) for _ in range(25)]
    pool = [*lines, *[edited(rng, x, rng.randint(0, 3), "abé€漢") for x in lines for _ in range(3)], "  Spaced \t LINE with words and more  ", "spaced line with words and more", "short", "short", ""]
    texts = [*EDGES, *["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 8))) for _ in range(40)]]
    s = line_dedup.Settings(broadcast=broadcast, block=block)
    table = docs(spark, texts)
    got = {r.doc_id: r for r in line_dedup.repeated_lines(table.unionByName(table.limit(14)), s=s).collect()}
    norm = lambda x: line_dedup.normal(x.encode())
    first = {}
    for i, t in enumerate(texts):
        for k, x in enumerate((t or "").split("\n")):
            if norm(x):
                first.setdefault(norm(x), (i, k))
    long = [x for x in first if len(x) >= s.shortest]
    near = {b for a in long for b in long if first[a] < first[b] and abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= 2}
    assert near
    for i, t in enumerate(texts):
        own = (t or "").split("\n") if t else []
        expected = [k for k, x in enumerate(own) if norm(x) and (first[norm(x)] != (i, k) or norm(x) in near)]
        assert (got[i].n_lines, list(got[i].removed), got[i].n_removed) == (len(own), expected, len(expected))
    kept = {r.doc_id: r.text for r in line_dedup.without_repeats(table, s=s, drop_empty=False).collect()}
    for i, t in enumerate(texts):
        gone = set(got[i].removed)
        assert kept[i] == (t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone))


@pytest.mark.parametrize("block", [2048, 40])
def test_line_dedup_of_a_large_group_of_lines_that_share_most_of_their_text(spark, block):
    """300 variants of one line, most of them more than two edits from all others, against brute force."""
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(12)]
    lines = []
    for _ in range(300):
        own = list(words)
        own[rng.randrange(12)] += "".join(rng.choice("wxyz") for _ in range(rng.choice([1, 3, 4])))
        lines.append(" ".join(own))
    got = line_dedup.repeated_lines(docs(spark, lines), s=line_dedup.Settings(block=block)).collect()
    gone = {j for j, x in enumerate(lines) if any(edit_distance(x, y) <= 2 for y in lines[:j])}
    assert 0 < len(gone) < 299
    assert {r.doc_id for r in got if r.n_removed} == gone


def test_line_dedup_edges(spark):
    assert line_dedup.repeated_lines(docs(spark, [])).count() == 0
    long = "the same long line of text stands here"
    out = line_dedup.without_repeats(docs(spark, [long, long, f"{long}\nand another line that is new", None, ""])).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(0, long), (2, "and another line that is new"), (3, None), (4, "")]
    nulls = line_dedup.repeated_lines(docs(spark, [long, long], ids=[5, None])).collect()
    assert {r.doc_id: r.n_removed for r in nulls} == {5: 1, None: 0}
    short = line_dedup.without_repeats(docs(spark, ["Read more\n\nfirst", "read  more\n\nread morn", "Read more", " \n "])).collect()
    assert sorted((r.doc_id, r.text) for r in short) == [(0, "Read more\n\nfirst"), (1, "\nread morn"), (3, " \n ")]
    near = line_dedup.repeated_lines(docs(spark, [long, long.replace("same", "sane")], ids=[5, None])).collect()
    assert {r.doc_id: r.n_removed for r in near} == {5: 1, None: 0}


# --- licences ---------------------------------------------------------------------


def test_license_scan_base_equals_brute_force(spark):
    rng = random.Random(4)
    bits = ["cc", "by", "CC-BY", "general", "public", "license", "GENERAL public\nLicense", "all rights reserved", "all", "rights", "reserved.", "é", "x", "cc by", "accby", "ccé by"]
    texts = [*EDGES, *[rng.choice([" ", ", ", "\n"]).join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(60)]]
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = sorted((k, label) for phrase, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


def test_license_scan_finds_notices_with_edits(spark):
    texts = ["xx Released under teh MIT license. yy", "Licensed under the Apache Licence, Version 2.0 (the", "relased undr the mit licens", "nothing at all", "released under other terms"]
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, texts)).collect()}
    assert got[0].labels == "mit" and 0.8 < got[0].score < 1
    assert got[1].labels == "apache-2.0" and got[1].spans[0].start == 0 or got[1].spans[0].start == 1
    assert got[3].labels == got[4].labels == "" and got[3].score == 0
    assert license_scan.scan(docs(spark, [])).count() == 0


def brute_notices(flat, notices):
    """Of all spans of whole words within the errors, the best first, none that overlaps a better one."""
    starts = [k + 1 for k, x in enumerate(flat[:-1]) if x == " "]
    ends = [k for k, x in enumerate(flat) if x == " " and k]
    found = []
    for text, label in notices.notices.items():
        errors = max(1, min(notices.most, len(text) // notices.per))
        for a in starts:
            for b in ends:
                if abs(b - a - len(text)) <= errors and (n := edit_distance(flat[a:b], text)) <= errors:
                    found.append((n / len(text), a, b, label))
    kept = []
    for x in sorted(found, key=lambda x: (x[0], x[1] - x[2], x[1])):
        if all(x[2] <= y[1] or y[2] <= x[1] for y in kept):
            kept.append(x)
    return sorted((a, b, label, round(1 - n, 9)) for n, a, b, label in kept)


def test_license_scan_finds_adjacent_notices(spark):
    rng = random.Random(9)
    texts = ["this werk is licensd under the gnu general public license version 3 this work is licensed under the gnu general public license version 2"]
    for _ in range(40):
        notice = rng.choice([x for x in license_scan.NOTICES if "general" in x or "cc by" in x or "mit" in x or "mozilla" in x])
        parts = []
        for _ in range(rng.randint(2, 4)):
            w = (rng.choice(list(license_scan.NOTICES)) if rng.random() < 0.2 else notice).split()
            for k in rng.sample([k for k, x in enumerate(w) if len(x) > 4], rng.choice([0, 0, 1, 1, 2]) if len(" ".join(w)) > 36 else rng.choice([0, 1])):
                w[k] = rng.choice([w[k][:2] + "z" + w[k][3:], w[k][:2] + w[k][3:], w[k][:2] + "q" + w[k][2:]])
            parts.append(" ".join([*w, *["ab"] * rng.choice([0, 0, 1, 3])]))
        texts.append(" ".join(parts))
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, texts)).collect()}
    assert got[0].labels == "gpl,gpl-2.0,gpl-3.0"
    for i, t in enumerate(texts):
        assert [(x.start, x.stop, x.label, round(x.score, 9)) for x in got[i].spans] == brute_notices(license_scan.normal(t), license_scan.Notices()), t


# --- quality rules ----------------------------------------------------------------


def brute_stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    covered = {k + j for k, x in enumerate(tri) if tri.count(x) > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [*EDGES, *[rng.choice([" ", "\n", " # "]).join(rng.choice(["a", "b", "cé", "d|", "<e>"]) for _ in range(rng.randint(0, 120))) for _ in range(60)]]
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, repeat = brute_stats(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)


def test_frequent_lines_deplete_all_but_the_first(spark):
    rng, vocab = random.Random(8), vocabulary()
    own = lambda: " ".join(rng.choice(vocab) for _ in range(70))
    menu = own()
    texts = [f"{menu.upper()}\n{own()[: 10 + k]}" for k in range(8)] + [own() for _ in range(4)] + [f"{menu}\n{own()}\n{own()}"]
    rules = quality_rules.Rules(max_line_docs=5)
    table = docs(spark, texts)
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(table, rules=rules).collect()}
    assert got == {0: True} | dict.fromkeys(range(1, 8), False) | dict.fromkeys(range(8, 13), True)
    clean = {r.doc_id: r.text for r in quality_rules.apply_rules(table, rules=rules, clean=True).where("kept").collect()}
    assert clean[0] == texts[0] and clean[8] == texts[8] and clean[12] == texts[12].split("\n", 1)[1]
    copies = docs(spark, [texts[8]] * 20)  # equal texts are one document
    assert quality_rules.apply_rules(copies, rules=rules).where("kept").count() == 20
    twice = quality_rules.apply_rules(table.unionByName(table), rules=rules).collect()
    assert all(r.kept == got[r.doc_id] for r in twice) and len(twice) == 26
    assert quality_rules.apply_rules(docs(spark, [None, own()], ids=[None, None], source=None)).count() == 2
    assert quality_rules.apply_rules(docs(spark, [])).count() == 0


# --- substrings -------------------------------------------------------------------


def brute_removed(texts, length):
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(gone)) if gone[p] and (not p or not gone[p - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("s", [substring_dedup.Settings(), substring_dedup.Settings(length=20, gram=6, block=60, spans=3, hot=4, piece=64)])
def test_substrings_equal_brute_force(spark, s):
    rng, vocab = random.Random(s.length), vocabulary()
    passages = [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 60))) for _ in range(8)]
    texts = [*EDGES, "ab" * 200, "a" * 150, "xab" * 90, "é" * 130]
    for _ in range(60):
        texts.append(rng.choice(["", " ", "\n"]).join(rng.choice([rng.choice(passages), rng.choice(vocab), rng.choice(vocab) + "ß", rng.choice(passages)[5:]]) for _ in range(rng.randint(1, 12))))
    texts += texts[20:24]
    table = docs(spark, texts, ids=[3 * k for k in range(len(texts))])
    got = substring_dedup.remove_repeats(table.unionByName(table.limit(15)).repartition(3), s=s).collect()
    expected = brute_removed({3 * k: t for k, t in enumerate(texts)}, s.length)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == expected
    assert len(got) == len(texts) + 15


def test_substring_edges(spark):
    long = " ".join(vocabulary()[:60])
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs(spark, [long, long], ids=[None, 4])).collect()}
    assert got == {None: 0, 4: 0}
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0
    kept = substring_dedup.remove_repeats(docs(spark, [long, f"new {long} end"]), texts=True).orderBy("doc_id").collect()
    assert bytes(kept[1].kept).startswith(b"new") and len(kept[1].kept) < 15


def test_equal_windows_compares_every_byte():
    s = substring_dedup.Settings(length=20, gram=6)
    base = bytes(range(30))
    data = [base] + [base[:k] + b"\xff" + base[k + 1 :] for k in range(20)] + [base]
    start = np.arange(len(data)) * 100
    own, at = np.arange(len(data)), start.copy()
    got = substring_dedup.equal_windows(data, start, own, at, np.arange(1, len(data)), np.zeros(len(data) - 1, np.int64), s, block=7)
    assert got.tolist() == [False] * 20 + [True]
