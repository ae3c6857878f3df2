"""Ranked search, hard negatives and sharding against brute-force versions, also where they work in many small steps."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures as fx
from waymark.llm import hard_negatives, ranked_search, sharding
from waymark.llm.staging import shared_path

TERM = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    return fx.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    path = shared_path(spark, "corpus")
    clashes = "block term ord tf n ids item place part size shard slot doc g k r range at start file score".split()
    spark.createDataFrame(rows, SCHEMA).repartition(3, "n_chars").withColumns({c: F.lit("clash") for c in clashes}).write.parquet(path)
    return spark.read.parquet(path)


def ranked(rows, items, top):
    """(item_id, rank, score) of each item, and the ids that may stand there."""
    terms = lambda t: re.findall(TERM, (t or "").translate(fx.LOWER))
    counts = [(d, Counter(terms(t))) for d, t in rows]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, total, df = len(counts), sum(n for _, _, n in counts), Counter(t for _, c, _ in counts for t in c)
    wanted = defaultdict(set)
    for item, t in items:
        wanted[item] |= set(terms(t))
    out = []
    for item, ts in wanted.items():
        found = []
        for d, c, n in counts:
            m = 100 - 50 + (50 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:top])]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search(spark, docs, rows, monkeypatch, small):
    if small:
        for name, value in (("BLOCK", 7), ("ITEMS", 2), ("VOCABULARY", 0)):
            monkeypatch.setattr(ranked_search, name, value)
    pairs = [(r[0], r[1]) for r in rows]
    words = [w for _, t in pairs[:30] for w in (t or "").split()]
    rng = random.Random(4)
    items = [(i, " ".join(rng.sample(words, 12))) for i in range(9)] + [(20, "ÀÉ two WORDS don't"), (21, None), (22, "?!"), (23, "nowhere-at-all"), (None, words[0]), (5, words[1])]
    items += [(30, "a"), (31, "same line again here"), (3, None)]
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, term string")
    for top in (50, 3):
        got = [tuple(r) for r in ranked_search.search(docs, asked, top).collect()]
        assert Counter(got) == Counter(ranked(pairs, items, top))


def test_ranked_search_of_empty_tables(spark, docs):
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(docs.filter("1 = 0"), asked).count() == 0
    assert ranked_search.search(docs, asked.filter("1 = 0")).count() == 0
    nulls = docs.limit(5).withColumn("text", F.lit(None).cast("string"))
    assert ranked_search.search(nulls, asked).count() == 0


def test_stages_leave_out_no_document(spark, monkeypatch):
    """Common words decide where rare ones tie, and bundles are pruned in between."""
    monkeypatch.setattr(ranked_search, "OWNERS", (0.02, 0.2, 0.6))
    monkeypatch.setattr(ranked_search, "BLOCK", 16)
    rng = random.Random(12)
    vocab, weights = [f"w{i}" for i in range(80)], [1 / (i + 1) for i in range(80)]
    texts = [(i, " ".join(rng.choices(vocab, weights, k=rng.randint(3, 60)))) for i in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=6))) for i in range(25)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in ranked_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), 5).collect()]
    assert Counter(got) == Counter(ranked(texts, items, 5))


def vectors(n=260, dim=12, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    out = []
    for i in range(n):
        c = int(r.integers(6))
        x = centres[c] + 0.35 * r.normal(size=dim)
        out.append((i, int(r.integers(4)), [float(np.float32(v)) for v in x / np.linalg.norm(x)], i % 10 == 0))
    hot = out[3][2]
    out += [(1000 + i, 1, hot, i % 25 == 0) for i in range(90)]  # a vector that a fifth of the rows have
    out += [(2000 + i, 2, hot, i == 0) for i in range(8)]
    out += [out[5], out[5], out[20], out[20]]  # repeated rows
    out += [(7, 3, out[11][2], True)]  # an id with two vectors
    nan, inf = float("nan"), float("inf")
    out += [(None, 1, hot, True), (3000, None, hot, True), (3001, 1, None, True), (3002, 1, [nan] + hot[1:], True), (3003, 1, [inf] + hot[1:], True), (3004, 1, [None] + hot[1:], True)]
    out += [(3010, 1, [], True), (3011, 9, hot, True), (3012, 1, [0.0] * dim, False), (3013, 2, hot[:5], True), (3014, 2, [50.0 * x for x in hot], False)]
    return out


def mined(rows, k=5, low=80, high=100):
    ok = {(i, y, tuple(math.floor(256 * v) for v in x), a) for i, y, x, a in rows if None not in (i, y, x) and all(v is not None and math.isfinite(v) for v in x)}
    score = lambda p, q: sum(a * b for a, b in zip(p, q))  # noqa: E731, B905
    out, trimmed = [], {(i, y, tuple(np.trim_zeros(q, "b")), a) for i, y, q, a in ok}
    for i, y, q, anchor in trimmed:
        if not anchor:
            continue
        each = sorted(((-score(q, p), j, z) for j, z, p, _ in trimmed if j != i))
        for ps, pid, _ in [x for x in each if x[2] == y][:k]:
            fits = [x for x in each if x[2] != y and low * -ps <= 100 * -x[0] <= high * -ps][:k]
            out += [(i, pid, n + 1, nid, -ps, -ns) for n, (ns, nid, _) in enumerate(fits)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:
        for name, value in (("CLUSTER_ANCHORS", 6), ("BLOCK", 4), ("FIRST", 9), ("GROWTH", 2), ("PART", 11), ("CHUNK", 5), ("BINS", 32)):
            monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, label int, embedding array<float>, is_anchor boolean, q string").repartition(4)
    run = hard_negatives.Mining(df, 5, 5)
    got = [tuple(r) for r in run.run(80, 100).collect()]
    assert Counter(got) == Counter(mined(rows))
    if small:
        assert len(run.lists.bands) > 4 and len(run.lists.centres) > 4


def test_hard_negatives_walk_only_as_far_as_they_must(spark, monkeypatch):
    """Tight clusters: candidates of other directions are never sent to a cluster."""
    for name, value in (("CLUSTER_ANCHORS", 6), ("FIRST", 30)):
        monkeypatch.setattr(hard_negatives, name, value)
    r = np.random.default_rng(1)
    rows = []
    for i in range(600):
        x = np.eye(8)[i % 8] + 0.02 * r.normal(size=8)
        rows.append((i, int(r.integers(3)), [float(v) for v in x / np.linalg.norm(x)], i % 10 == 0))
    sent = []
    band = hard_negatives.Mining.band
    monkeypatch.setattr(hard_negatives.Mining, "band", lambda self, r, clusters: sent.append((r, len(clusters))) or band(self, r, clusters))
    got = [tuple(x) for x in hard_negatives.mine(spark.createDataFrame(rows, "id long, label int, embedding array<double>, is_anchor boolean")).collect()]
    assert Counter(got) == Counter(mined(rows))
    assert max(r for r, _ in sent) < 3


def test_hard_negatives_of_odd_tables(spark):
    schema = "id long, label int, embedding array<float>, is_anchor boolean"
    assert hard_negatives.mine(spark.createDataFrame([], schema)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(1, 1, [1.0], True), (2, 2, [1.0], True)], schema)).count() == 0  # no positives
    assert hard_negatives.mine(spark.createDataFrame([(1, 1, [1.0], False), (2, 1, [1.0], None)], schema)).count() == 0  # no anchors
    with pytest.raises(Exception, match="too large"):
        hard_negatives.mine(spark.createDataFrame([(1, 1, [1e30], True), (2, 1, [1.0], True)], schema)).count()


def by_rule(rows, shards, ranges, of_shard=200, of_range=16):
    """Rows in the order of their keys, cut at equal bytes."""
    import hashlib

    each = []
    for d, t in rows:
        raw = (t or "").encode()
        each.append((int(hashlib.md5(raw).hexdigest()[:15], 16), d is not None, d or 0, len(raw) + 8, zlib.crc32(raw), d))
    each.sort()
    total, groups, start = sum(e[3] for e in each), {}, 0
    target = max(1, total // min(sharding.RANGES, max(ranges, total // sharding.RANGE_BYTES)))
    whole = min(total // (of_shard * shards), target // of_range)
    for g, *_, size, _, _ in each:
        groups.setdefault(g, [start, 0])[1] += size
        start += size
    out, start, used = [], 0, Counter()
    for g, _, _, size, crc, d in each:
        first, held = groups[g]
        middle = 2 * first + held if held <= whole else 2 * start + size
        s = min(shards - 1, middle * shards // (2 * total))
        out.append((d, size, crc, "bytes", s, used[s], None))
        used[s] += 1
        start += size
    return out


@pytest.mark.parametrize(("samples", "shards"), [(8, 24), (1, 24), (8, 3), (1, 1)])
def test_sharding(spark, docs, rows, monkeypatch, samples, shards):
    monkeypatch.setattr(sharding, "SAMPLES", samples)
    got = [tuple(r) for r in sharding.digests(docs, shards).collect()]
    assert Counter(got) == Counter(by_rule([(r[0], r[1]) for r in rows], shards, 4 * shards))


@pytest.mark.parametrize("equal", [False, True])
def test_sharding_of_a_hot_group(spark, equal):
    """A text that most rows have fills many shards evenly, also when the rows are equal."""
    rows = [(None if equal else i, "copy " * 20) for i in range(900)] + [(i, f"text {i} " * (i % 9)) for i in range(400)]
    run = sharding.Sharding(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(5), sharding.text_size(F.col("text")), sharding.text_group(F.col("text")), F.col("doc_id"), 24
    )
    cuts, weights = run.splitters()
    assert ((weights[0] - weights[2]) <= 2 * run.target).all() and cuts.shape[1] > 24
    out = run.run()
    sizes = [r["s"] for r in out.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    largest = max(len(t.encode()) + 8 for _, t in rows)
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 2 * largest
    slots = out.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.count_distinct("slot").alias("d")).collect()
    assert all(r["n"] == r["m"] + 1 == r["d"] for r in slots)


def test_sharding_of_odd_tables(spark, docs):
    assert sharding.digests(docs.filter("1 = 0")).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in sharding.digests(one).collect()] == [(1, 8, 0, "bytes", 12, 0, None)]


def test_written_shards_hold_all_rows(spark, docs, rows, tmp_path):
    sharding.write_shards(docs, f"file:{tmp_path}/shards", 5)
    back = spark.read.parquet(f"file:{tmp_path}/shards")
    assert Counter((r["doc_id"], r["text"], r["slot"]) for r in back.collect()) == Counter((r[0], r[1], "clash") for r in rows)
    assert back.select("shard").distinct().count() == 5
