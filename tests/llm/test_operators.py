"""Operators of the subpackage against brute-force versions, on a corpus with nulls, empty and long texts, repeated rows
and columns with clashing names, and on empty tables."""

import hashlib
import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tests.llm import fixtures as fx
from waymark.llm import decontamination, near_duplicates, packing, pieces, quality_model, quality_rules, staging, substring_dedup, token_counts, token_store, url_reputation, warc
from waymark.llm.pieces import Encoder
from waymark.llm.staging import Stage, shared_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
CLASHES = "row key version h w s kept failed doc dedup rep n_words __listed_id lex quality".split()


@pytest.fixture(scope="module")
def rows():
    return fx.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    path = shared_path(spark, "corpus")
    df = spark.createDataFrame(rows, SCHEMA).repartition(3, "n_chars")
    df.withColumns({c: F.lit("clash") for c in CLASHES}).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, docs):
    path = shared_path(spark, "empty")
    docs.filter("1 = 0").write.parquet(path)
    return spark.read.schema(docs.schema).parquet(path)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(fx.benchmark(), "item_id long, text string")


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def test_quality_rules(docs, rows, empty):
    out = quality_rules.judge(docs)
    got = out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = []
    for d, t, *_ in rows:
        w, lines = fx.words(t), [x for x in (t or "").split("\n") if fx.words(x)]
        rep = fx.repeat_words(w)
        want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), rep, len(w) < 20 or 100 * rep > 30 * len(w)))
    same(got, want)
    assert quality_rules.judge(empty).count() == 0
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and kept.count() == out.filter("kept").count()
    table = quality_rules.ablation(quality_rules.ledger(docs)).collect()
    masks = [r["failed"] for r in quality_rules.ledger(docs).collect()]
    for r in table:
        bit = quality_rules.BIT[r["rule"]]
        assert (r["n_docs"], r["n_kept"]) == (len(masks), sum(m == 0 for m in masks))
        assert (r["n_failed"], r["n_only"], r["n_kept_without"]) == (sum(bool(m & bit) for m in masks), masks.count(bit), sum(m & ~bit == 0 for m in masks))
    assert {r["rule"] for r in table} == set(quality_rules.BIT)


def test_token_counts(docs, rows, empty):
    library = Tokenizer.from_file(BYTES)
    got = token_counts.count_tokens(docs, BYTES).collect()
    same(got, [(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in rows])
    assert token_counts.count_tokens(empty, BYTES).count() == 0


def test_chunk_maps_compose(rows):
    counter = token_counts.Counter(BYTES)
    for _, t, *_ in rows:
        t = (t or "")[:3000]
        chunks = [t[i : i + 7] for i in range(0, len(t), 7)] or [""]
        total = token_counts.state_maps(counter, chunks)
        while len(total) > 1:  # in pairs, as the rounds of a scan do
            total = [token_counts.compose(counter, *total[i : i + 2]) if i + 1 < len(total) else total[i] for i in range(0, len(total), 2)]
        assert token_counts.finish(counter, total[0]) == counter.counts([t])[0]


def test_long_texts_are_scanned_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK_CHARS", 50)
    library = Tokenizer.from_file(BYTES)
    texts = ["don't " * 900, "x" * 3000, "'" * 400 + "s" * 300, "<|endoftext|>" * 40 + "a b<|endoftext|>", " \n" * 500, "日本語。" * 300, "\u1c89 \U00010d50x" * 60, "a'll 12,3" * 200]
    got = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTES).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_the_library_on_every_code_point(path):
    library, own = Tokenizer.from_file(path), Encoder(path)
    # all code points that Python knows, and a share of the others, which go to the library anyway
    known = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Cs", "Co") or ord(c) % 97 == 0 and not "\ud800" <= c <= "\udfff"]
    texts = [f"a{c}b {c}{c}1{c}!" for c in known]
    want = [np.array(e.ids, "<u2").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want


def test_encoder_beyond_what_it_remembers(monkeypatch, rows):
    monkeypatch.setattr(pieces, "MAX_PIECES", 40)
    monkeypatch.setattr(pieces, "BATCH_CHARS", 200)
    library, own = Tokenizer.from_file(WORDS), Encoder(WORDS)
    texts = [t or "" for _, t, *_ in rows] * 2
    assert own.encode(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_store(spark, docs, rows, empty):
    library = Tokenizer.from_file(WORDS)
    store = token_store.Store(spark, Stage(spark, "test"))
    store.write(docs, WORDS, 2)
    got = sorted(token_store.read_documents(store.chunks, store.recipes).collect(), key=lambda r: r["start"])
    want = [(d, library.encode(t or "", add_special_tokens=False).ids + [2]) for d, t, *_ in rows]
    same([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got], [(d, len(i), crc(i)) for d, i in want])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert store.chunks.count() == store.chunks.select("digest").distinct().count()
    assert token_store.verify_manifest(store).count() == 0
    assert token_store.store_and_read(empty, WORDS, 2).count() == 0


def test_damaged_store_is_noticed(spark, docs):
    store = token_store.Store(spark, Stage(spark, "damaged"))
    store.write(docs.limit(3), WORDS, 2)
    with pytest.raises(Exception, match="missing"):
        token_store.read_documents(store.chunks.limit(0), store.recipes).collect()


def test_packing(docs, rows, empty):
    library = Tokenizer.from_file(BYTES)
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, BYTES).collect():
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        windows[r["sequence_id"]].append(r)
    want = Counter()
    for d, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want[d, len(ids)] += 1
        if want[d, len(ids)] == 1:
            for r in pieces[d, len(ids)]:
                assert crc(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]
    for (d, n), k in want.items():  # every id lies in one piece of each of the k equal rows
        covered = Counter(i for r in pieces[d, n] for i in range(r["start"], r["start"] + r["length"]))
        assert set(covered.values()) == {k} and len(covered) == n
    for seq in windows.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(empty, BYTES).count() == 0


def test_packing_prefers_lexical_neighbours():
    r = np.random.default_rng(1)
    topics = [r.integers(1000 * k, 1000 * k + 400, (20, 300)) for k in range(4)]
    texts = [d.astype(np.uint16) for t in zip(*topics, strict=True) for d in t]
    shard = packing.Shard(texts)
    shard.used[0] = True
    assert all(n % 4 == 0 for n in shard.neighbours(0))


def test_substring_dedup(docs, rows, empty):
    got = substring_dedup.remove_repeats(docs).select("doc_id", "dedup.n_words", "dedup.n_removed", "dedup.kept_text").collect()
    kept = fx.kept_words([t for _, t, *_ in rows])
    want = [(d, len(fx.words(t)), len(fx.words(t)) - len(k), " ".join(k)) for (d, t, *_), k in zip(rows, kept, strict=True)]
    same(got, want)
    assert substring_dedup.remove_repeats(empty).count() == 0
    rewritten = substring_dedup.rewrite(docs)
    assert rewritten.columns == docs.columns
    assert rewritten.filter("n_chars <> length(text) or dedup <> 'clash'").count() == 0


def test_substrings_of_rows_without_id_long_chains_and_circles(spark):
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, long, circle = text(60), text(1500), text(50)
    rows = [(None, f"{text(20)} {shared} {text(9)}"), (1, f"{shared} {text(30)}"), (2, f"{text(5)} {long}"), (3, f"{long} {text(6)}"), (4, long[: len(long) // 2]),
            (5, " ".join([circle] * 6)), (6, " ".join([circle] * 3)), (7, shared), (7, shared), (7, shared + " x")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "dedup.kept_text").collect()
    same(got, [(d, " ".join(k)) for (d, _), k in zip(rows, fx.kept_words([t for _, t in rows]), strict=True)])


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, rows, width):
    got = near_duplicates.near_duplicates(docs, width).collect()
    want = fx.classes([(d, t) for d, t, *_ in rows], width)
    same(got, [(d, len(fx.shingles(t, width)), want.get(d), d is None or want[d] == d) for d, t, *_ in rows])


def test_one_near_duplicate_stays(docs, rows, empty):
    want = fx.classes([(d, t) for d, t, *_ in rows], 5)
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids == Counter({**{d: 1 for d in want if want[d] == d}, None: 2})
    assert near_duplicates.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_links_beside_crowds_are_found(spark, percent):
    """Two crowds of near copies, strangers that are near one member only, and chains of small steps."""
    import random

    r = random.Random(11)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    base = [r.choice(vocab) for _ in range(150)]

    def changed(words, k):
        out = list(words)
        for i in r.sample(range(len(out)), k):
            out[i] = r.choice(vocab)
        return out

    rows = [changed(base, 2) for _ in range(60)] + [changed(base[:75] + [r.choice(vocab) for _ in range(75)], 2) for _ in range(5)]
    for k in (1, 2, 3, 4, 5, 6):
        rows += [changed(rows[r.randrange(60)], k) for _ in range(4)]
    step = [r.choice(vocab) for _ in range(100)]
    for _ in range(15):
        step = changed(step, 1)
        rows.append(step)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == fx.classes(rows, 5, percent)


def test_similarities_that_the_trees_are_not_made_for_are_refused(docs):
    with pytest.raises(ValueError, match="80"):
        near_duplicates.near_duplicates(docs, 5, 45)


def test_decontamination(docs, rows, items, empty):
    got = decontamination.contamination(docs, items).drop("version").collect()
    want = []
    for d, t, *_ in rows:
        n, hit, found = fx.contamination(t, fx.benchmark())
        want.append((d, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0 and 20 * hit >= n))
    same(got, want)
    clean = decontamination.clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == sum(not w[5] for w in want)
    assert decontamination.contamination(empty, items).count() == 0
    assert decontamination.contamination(docs, items.limit(0)).filter("contaminated").count() == 0


@pytest.mark.parametrize("bounds", [("WINDOWS_BROADCAST",), ("PREFIXES_INLINE",), ("WINDOWS_BROADCAST", "PREFIXES_INLINE")])
def test_large_benchmarks_take_the_other_way(docs, items, monkeypatch, bounds):
    want = decontamination.contamination(docs, items).collect()
    for bound in bounds:
        monkeypatch.setattr(decontamination, bound, 0)
    same(decontamination.contamination(docs, items).collect(), want)


def test_long_lists_of_ids_are_shuffled(docs, monkeypatch):
    near = near_duplicates.near_duplicates(docs, 4, 80).collect()
    cut = substring_dedup.rewrite(docs).select("doc_id", "text").collect()
    for module in (near_duplicates, substring_dedup, staging):
        monkeypatch.setattr(module, "ROWS_BROADCAST", 0)
    same(near_duplicates.near_duplicates(docs, 4, 80).collect(), near)
    same(substring_dedup.rewrite(docs).select("doc_id", "text").collect(), cut)


def test_quality_model(spark, docs, rows, empty):
    labels = [(d, int(len(fx.words(t)) > 30), 0) for d, t, *_ in rows if d is not None] + [(2, None, None), (1, 0, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_model.learn_and_score(docs, table).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    nothing = quality_model.learn_and_score(docs, table.limit(0)).collect()
    assert {r["score"] for r in nothing} == {0.5}
    assert quality_model.learn_and_score(empty, table).count() == 0


def brute_features(t):
    """The features of a text, by plain Python."""
    t = t or ""
    w, lines = fx.words(t), [x for x in t.split("\n") if x.strip(" ")]
    per = lambda x, d: x / d if d > 0 else 0.0
    return (
        math.log1p(len(w)), per(len(t), len(w)), per(sum(len(x) <= 3 for x in w), len(w)), float(max(map(len, w), default=0)), per(len(set(w)), len(w)),
        per(sum(c in "#*$%&|<>" for c in t), len(w)), per(sum("A" <= c <= "Z" for c in t), len(t)), per(sum("0" <= c <= "9" for c in t), len(t)),
        per(t.count("!"), len(w)), per(sum(c in ".,;:?" for c in t), len(w)), per(len(t.encode()) - len(t), len(t)),
        per(len(lines) - len(set(lines)), len(lines)), per(len(w), len(lines)),
    )


def test_quality_features_and_scores_against_plain_python(docs, rows):
    got = Counter((r["doc_id"], *(round(r[n], 9) for n in quality_model.NAMES)) for r in quality_model.features(docs).collect())
    assert got == Counter((d, *(round(x, 9) for x in brute_features(t))) for d, t, *_ in rows)
    r = np.random.default_rng(5)
    x = r.random((500, 4)).round(1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float)
    model = quality_model.fit(x, y)
    for row, score in zip(x[:60], model.score(x[:60]), strict=True):  # one bin of each table, added up
        z = model.intercept + sum(t[sum(v >= e for e in edges)] for v, edges, t in zip(row, model.edges, model.tables, strict=True))
        z += sum(t[sum(row[i] >= e for e in model.pair_edges[i]), sum(row[j] >= e for e in model.pair_edges[j])] for i, j, t in model.pairs)
        assert score == pytest.approx(1 / (1 + math.exp(-z)))


def test_a_shallow_tree_is_the_best_of_all_cuts():
    r = np.random.default_rng(8)
    g, h = r.normal(size=9), r.random(9) + 0.1
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + quality_model.LAMBDA)
    best = max(range(1, 9), key=lambda k: gain(0, k) + gain(k, 9))
    step = quality_model._shallow_tree(g, h)
    edges = [0]
    for a, b in ((0, best), (best, 9)):
        cut = max(range(a + 1, b), key=lambda k: gain(a, k) + gain(k, b), default=b)
        edges += [cut, b] if cut < b and gain(a, cut) + gain(cut, b) > gain(a, b) else [b]
    for a, b in zip(edges, edges[1:], strict=False):
        assert np.allclose(step[a:b], g[a:b].sum() / (h[a:b].sum() + quality_model.LAMBDA))


def test_quality_is_learned_from_unheld_rows_only(spark):
    rows = [(i, ("good words stand here in plain order " if i % 2 else "## !! $$ 77 ") * (5 + i % 7)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, i % 2, 0) for i in range(400)]
    wrong = [(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q, t) for i, q, t in labels]  # held-out labels change nothing
    one, two = (quality_model.learn_and_score(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect() for x in (labels, wrong))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    assert all((r["score"] > 0.5) == bool(r["doc_id"] % 2) for r in one)


def test_additive_model_learns_a_pair():
    r = np.random.default_rng(3)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.fit(x[:3000], y[:3000])
    assert np.mean((model.score(x[3000:]) > 0.5) == y[3000:]) > 0.95


PAGES = [
    (1, "http://A.Example.com/en/1", "same"), (2, "https://b.example.com/fr/2?x#y", "same"), (3, "nothing", None), (4, None, ""), (5, "http://www.example.com/en/", "é\r\n\r\nWARC/1.1\r\n"),
    (6, "x://net/es/3", "one"), (7, "http://h.net?q=/fr/", "two"), (9, "http://r.org/", "first of two"), (9, "http://r.org/", "another text"), (3, "http://r.org/3", "first of two"), (1, "http://r.org/1", "another text"), (2, "https://b.example.com/fr/2?x#y", "same"), (None, "http://n.org/", "same"), (8, "http://a b\r\n.com/", "x" * 200_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id long, url string, html string, digest string, host string")


def write_nothing(spark, pages):
    path = shared_path(spark, "warc-empty")
    warc.archive(pages.limit(0), path)
    return path


def test_warc_round_trip(spark, pages, monkeypatch):
    path = shared_path(spark, "warc-test")
    warc.archive(pages, path)
    got = warc.read_resolved(spark, path)
    assert got.filter("payload_digest <> header_digest").count() == 0
    import base64

    want = []
    for p, _, html in PAGES:
        data = (html or "").encode()
        top = max((q for q, _, h in PAGES if (h or "") == (html or "") and q is not None), default=None)
        response = top is None or p == top
        want.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else top))
    same(got.drop("header_digest").collect(), want)
    # small archives, and one for each record that is longer than the last class
    monkeypatch.setattr(warc, "SIZE_CLASSES", (10, 100))
    monkeypatch.setattr(warc, "FILE_BYTES", 20)
    path = shared_path(spark, "warc-test")
    warc.archive(pages, path)
    same(warc.read_resolved(spark, path).drop("header_digest").collect(), want)
    assert warc.read_resolved(spark, write_nothing(spark, pages)).count() == 0
    sized = warc.resolve(pages, min_bytes=10)
    assert sized.filter("payload_bytes < 10 and record_type = 'revisit'").count() == 0


def test_urls_are_percent_encoded(spark):
    urls = ["http://a.org/b c", "x\ny\tz\x7f", "", "é😀 ü", "http://a.org/%20"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r["e"] for r in df.select(warc.percent_encoded(F.col("u")).alias("e")).collect()] == ["http://a.org/b%20c", "x%0Ay%09z%7F", "", "é😀%20ü", "http://a.org/%20"]


def test_url_rules_and_reputation(spark, pages):
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 1, 1), (6, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_reputation.judge(pages, labels).collect()}
    assert got == {
        (1, "a.example.com", "/en/1", "example.com/en/", "block"), (2, "b.example.com", "/fr/2", "com/", "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"),
        (5, "www.example.com", "/en/", "www.example.com/en/", "allow"), (6, "net", "/es/3", "net/es/", "block"), (7, "h.net", "", None, "allow"),
        (None, "n.org", "/", None, "allow"), (9, "r.org", "/", None, "block"), (3, "r.org", "/3", None, "block"), (1, "r.org", "/1", None, "block"), (8, "a b\r\n.com", "/", "com/", "allow"),
    }
    bad = spark.range(200).select(F.col("id").alias("page_id"), F.lit("http://bad.org/x").alias("url"))
    all_bad = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    mixed = bad.union(spark.range(1000, 1400).select("id", F.lit("http://good.org/x")))
    marked = all_bad.union(spark.range(1000, 1400).select("id", F.lit(1), F.lit(0)))
    verdicts = {r["host"]: r["verdict"] for r in url_reputation.judge(mixed, marked).collect()}
    assert verdicts == {"bad.org": "block", "good.org": "allow"}
    assert url_reputation.judge(pages.limit(0), labels).count() == 0


def test_registered_domains_below_public_suffixes(spark):
    urls = spark.createDataFrame([(1, h, "") for h in ("x.a.co.uk", "b.co.uk", "co.uk", "uk", "y.b.com", "")], "page_id long, host string, path string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["host"]: (r["suffix"], r["domain"]) for r in url_reputation.host_counts(urls, labels).collect()}
    more = ("a.com:8080", "u:p@z.b.com:", "c.com.", "10.0.0.7", "10.0.0.7:81", "[::1]:8", "d.co.uk.:1", "...")
    odd = spark.createDataFrame([(1, h, "") for h in more], "page_id long, host string, path string")
    assert {r["host"]: (r["suffix"], r["domain"]) for r in url_reputation.host_counts(odd, labels).collect()} == {
        "a.com:8080": ("com", "a.com"), "u:p@z.b.com:": ("com", "b.com"), "c.com.": ("com", "c.com"), "10.0.0.7": ("#address", "10.0.0.7"), "10.0.0.7:81": ("#address", "10.0.0.7"),
        "[::1]:8": ("#address", "[::1]"), "d.co.uk.:1": ("co.uk", "d.co.uk"), "...": ("", ""),
    }
    assert got == {"x.a.co.uk": ("co.uk", "a.co.uk"), "b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "uk": ("uk", "uk"), "y.b.com": ("com", "b.com"), "": ("", "")}


def test_schema_of_empty_tables(empty):
    assert isinstance(quality_rules.judge(empty).schema["n_words"].dataType, T.LongType)


def test_packing_weighs_by_the_whole_corpus_and_looks_at_all_neighbours(spark):
    import math

    import numpy as np

    from waymark.llm import packing

    rng = np.random.default_rng(5)
    docs = [(rng.zipf(1.3, rng.integers(1, 200)) % 400).astype("<u2") for _ in range(60)]
    rows = [(7, 5, None, None), (None, None, None, None)]  # a full window, and what three tasks counted
    for part in (docs[:1], docs[1:20], docs[20:]):
        counted = packing.describe(part).df
        terms = np.flatnonzero(counted)
        rows.append((len(part), sum(map(len, part)), terms.astype("<u2").tobytes(), counted[terms].astype("<i8").tobytes()))
    schema = "start long, length long, ids binary, counts binary"
    stats = packing.corpus_stats(spark.createDataFrame(rows, schema).repartition(3))
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = {t: sum(t in d for d in docs) for t in range(400)}
    assert stats.n == n and stats.mean == mean and all(stats.df[t] == df[t] for t in df)
    assert packing.corpus_stats(spark.createDataFrame([], schema)).n == 0

    block = docs[:40]
    shard = packing.Shard(block, stats)

    def score(seed, i):
        tf = {t: int((block[i] == t).sum()) for t in set(block[seed].tolist())}
        norm = packing.K1 * (1 - packing.B + packing.B * len(block[i]) / mean)
        return sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * f * (packing.K1 + 1) / (f + norm) for t, f in tf.items() if f)

    for seed in range(40):
        shard.used[seed] = True
        scores = {i: score(seed, i) for i in range(seed + 1, 40)}
        got = list(shard.neighbours(seed))
        assert set(got) == {i for i, x in scores.items() if x > 0}
        assert all(scores[x] > scores[y] - 1e-9 for x, y in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("damage", ["lost", "shortened", "reordered"])
def test_store_and_read_verifies_its_manifest(spark, docs, monkeypatch, damage):
    write = token_store.Store.write

    def damaged(self, *args):
        write(self, *args)
        long = F.size("names") > 1
        if damage == "lost":
            self.recipes = self.recipes.filter(~long)
        else:
            names = F.slice("names", 1, F.size("names") - 1) if damage == "shortened" else F.reverse("names")
            self.recipes = self.recipes.withColumn("names", F.when(long, names).otherwise(F.col("names")))

    monkeypatch.setattr(token_store.Store, "write", damaged)
    with pytest.raises(ValueError, match="manifest"):
        token_store.store_and_read(docs, WORDS, 2)
