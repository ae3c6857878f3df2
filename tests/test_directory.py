"""Quirks of the directory's operators on hand-made records."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions import facts, pages, text
from waymark.operators import browse, categories, crawl, discovery, guides, hierarchy, lifecycle, linking, normalise, quality, ranking, results, schema
from waymark.plans import content, more
from waymark.plans import lifecycle as lifecycle_plans
from waymark.sources import collections, exports
from waymark.streaming import health


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first()["r"]


@pytest.fixture(scope="module")
def regions(spark):
    rows = [("a", None, "world"), ("b", "a", "country"), ("c", "b", "city"), ("lost", "gone", "city"), ("x", "y", "city"), ("y", "x", "city")]
    return spark.createDataFrame(rows, "region_id string, parent_region_id string, granularity string")


def test_closure_keeps_dangling_parents_and_ends_cycles(regions):
    got = {(r["region_id"], r["depth"], r["anc"]) for r in hierarchy.closure(regions).collect()}
    assert {("c", 0, "c"), ("c", 1, "b"), ("c", 2, "a"), ("lost", 1, "gone"), ("x", 0, "x"), ("x", 1, "y")} <= got
    assert not any(r == "x" and d > 1 for r, d, _ in got)
    assert {r["region_id"]: r["root"] for r in hierarchy.roots(regions).collect()}["lost"] == "lost"
    assert {r["region_id"]: r["anc"] for r in hierarchy.nearest(regions, "country").collect()} == {"c": "b", "b": "b", "a": None, "lost": None, "x": None, "y": None}


def test_root_counts_sum_to_entities(spark, regions):
    entities = spark.createDataFrame([("c",), ("c",), ("b",), ("none",)], "region_id string")
    got = {r["region_id"]: r["n"] for r in hierarchy.counts(entities, regions).collect()}
    assert got == {"a": 3, "b": 3, "c": 2, "lost": 0, "x": 0, "y": 0}


def test_first_of_overlapping_ranges(spark):
    cats = spark.createDataFrame([("p", 1.0, 10.0, 1), ("q", 5.0, None, 2)], "category_id string, min_v double, max_v double, ord int")
    values = spark.createDataFrame([(0.5,), (7.0,), (10.0,), (11.0,), (None,)], "v double")
    assert [r["matched"] for r in categories.first_match(values, cats, "v").orderBy("v").collect()] == [None, None, "p", "p", "q"]


def test_fact_predicates_on_missing_values(spark):
    df = spark.createDataFrame([(None, None), (5, [1, 2])], "f int, a array<int>")
    holds = lambda op, v: [r["r"] for r in df.select(facts.holds(facts.value_of(df, "f"), op, v).alias("r")).collect()]
    assert holds("eq", 5) == [False, True] and holds("neq", 5) == [True, False] and holds("neq", 6) == [True, True]
    assert holds("gt", 4) == [False, True] and holds("lte", 4) == [False, False] and holds("in", [5]) == [False, True]
    assert holds("contains", "5") == [False, True] and holds("no-such", 1) == [True, True]
    assert [r["r"] for r in df.select(facts.holds(facts.value_of(df, "a"), "contains", 2).alias("r")).collect()] == [False, True]


def test_pins_are_listed_whatever_the_filters_say(spark, regions):
    rows = [("e1", "c", "p", "active", 5, [1.0], ["t"], 1), ("e2", "c", "p", "archived", 9, [2.0], ["t"], 2), ("e3", "b", "p", "active", 7, [3.0], ["u"], 3)]
    entities = spark.createDataFrame(rows, "entity_id string, region_id string, category_id string, status string, score int, numeric_facts array<double>, tags array<string>, ord int")
    cats = spark.createDataFrame([("p", 1.0, None, 1)], "category_id string, min_v double, max_v double, ord int")
    specs = [{"id": "g", "tags_any": ["t"], "pins": ["e2", "e1", "nobody"], "sort_by": "score"}, {"id": "h", "region_id": "a", "limit": 1}, {"id": "none", "category_id": "zz"}]
    got = sorted((r["guide_id"], r["rank"], r["entity_id"]) for r in guides.resolve(entities, regions, cats, specs).collect())
    assert got == [("g", 1, "e2"), ("g", 2, "e1"), ("h", 1, "e1")]


def test_fingerprint_known_values(spark):
    assert one(spark, guides.fnv1a(F.lit("a"))) == "e40c292c" and one(spark, guides.fnv1a(F.lit("foobar"))) == "bf9cf968"


@pytest.mark.parametrize(
    ("said", "state"),
    [("Open until full", "open"), ("Opens soon, not yet open", "not_yet_open"), ("Closed (pending)", "closed"), ("Sold Out", "closed"), ("opens 1 Jul 2026", "not_yet_open"),
     ("opens May 5, 1999", None), ("TBA", None), ("", None), (None, None), ("not_yet_announced", "not_yet_open")],
)
def test_availability(spark, said, state):
    assert one(spark, text.availability(F.col("v"), "2024-01-01"), said) == state


@pytest.mark.parametrize(
    ("said", "left"),
    [
        ("A fine race. Registration is open. Bring water.", "A fine race. Bring water."),
        ("A fine race. Registration is open at USD 50.", "A fine race. Registration is open at USD 50."),
        ("Registration is open. That means you can register today. Bring water.", "Bring water."),
        ("Registration is closed. It was a good year.", "Registration is closed. It was a good year."),
        ("The course is flat and the bay is in view, registration is still open.", "The course is flat and the bay is in view."),
        ("Registration is open.", "Registration is open."),
        ("", ""), (None, None),
    ],
)
def test_scrub(spark, said, left):
    assert one(spark, text.scrub(F.col("v")), said) == left


def test_scrub_may_empty(spark):
    assert one(spark, text.scrub(F.col("v"), True), "Registration is open.") == ""


def test_questions(spark):
    same = lambda a, b: one(spark, text.near_duplicate(text.question_key(F.lit(a)), text.question_key(F.lit(b))))
    assert same("When is the race held?", "When is the race held this year?") and not same("When is the race held?", "Where is the race held?")
    assert not same("When is the race?", "When is the race held?") and not same("", "")
    items = F.array(*(F.struct(F.lit(q).alias("question")) for q in ("When is the race held?", "", "When is the race held this year?", "How far is it by bus?")))
    assert [r["question"] for r in one(spark, text.dedupe_faqs(items))] == ["When is the race held?", "How far is it by bus?"]


def test_small_text_functions(spark):
    assert one(spark, text.month_label(F.lit("2026-08-01"))) == "August 2026" and one(spark, text.month_label(F.lit("2026-13-01"))) is None
    assert tuple(one(spark, text.day_month(F.lit("2026-08-01")))) == ("1", "AUG") and one(spark, text.month_key(F.lit("soon"))) is None
    assert one(spark, text.humanise(F.lit("not_yet_OPEN"))) == "Not Yet OPEN" and one(spark, text.humanise(F.lit("as is_it"))) == "as is_it"
    assert one(spark, text.strip_score(F.lit("Great (85/100)  run"))) == "Great run"
    assert one(spark, text.strip_artifacts(F.lit('a <cite index="1">b</cite> [16-8] c'))) == "a b c"
    assert one(spark, text.slugify(F.lit("  Crème Brûlée -- 2026! "))) == "creme-brulee-2026"
    assert one(spark, text.slugify(F.col("v")), "Łódź Žižkov ﬁn Ⅳ") == "odz-zizkov-fin-iv" and one(spark, text.slugify(F.col("v")), None) is None


def test_html(spark):
    html = "<head><title>no</title></head><!-- x -->A &amp;lt; &#8364;&#65; <b>bold</b><br/>two<p>three\t four</p><script>var a='</p>';</script>&nbsp;end"
    assert one(spark, pages.html_to_text(F.col("v")), html) == "A < €A bold\ntwo three four\nend"
    found = one(spark, pages.links(F.col("v")), '<a href="#x">no</a><a class=c href=\'/p?q\'> <i>yes</i> </a><a href="b"></a>')
    assert [tuple(a) for a in found] == [("/p?q", "yes")]
    made = lambda h: one(spark, pages.absolute(F.lit(h), F.lit("https://h.org/a/b?c")))
    assert (made("/x"), made("y"), made("http://z/")) == ("https://h.org/x", "https://h.org/a/y", "http://z/")
    assert (made("../x?y=../z"), made("./y/../z/"), made("?q"), made("//k.org")) == ("https://h.org/x?y=../z", "https://h.org/a/z/", "https://h.org/a/b?q", "https://k.org/")
    assert made("mailto:a@b.c") == "mailto:a@b.c" and one(spark, pages.absolute(F.lit("x"), F.lit("nowhere"))) is None


def test_odd_entities_don_t_end_a_job(spark):
    made = lambda h: one(spark, pages.html_to_text(F.col("v")), h)
    assert made("a&#1114112;b&#55296;c&#0000065;&#99999999999999999999;") == "a\ufffdb\ufffdcA\ufffd"
    assert made("&#38;#60; &amp;#60;") == "&#60; &#60;" and made("&#128512;") == "\U0001f600" and made(None) is None


def test_chunks_cover_the_text(spark):
    chunk = lambda t, **k: one(spark, pages.chunks(F.col("v"), **k), t)
    assert chunk("") == [] and chunk("x" * 10, size=10) == ["x" * 10]
    hard = chunk("x" * 25, size=10, overlap=2)
    assert hard == ["x" * 10, "x" * 10, "x" * 9]
    words = " ".join(f"w{i}" for i in range(40))
    parts = chunk(words, size=50, most=100, overlap=5)
    assert parts[0] == words[: len(parts[0])] and len(parts[0]) <= 50 and parts[-1].endswith("w39")
    assert len(chunk("x" * 1000, size=10, most=3, overlap=0)) == 3


def test_answers(spark):
    read = lambda t: one(spark, pages.answer_json(F.col("v")), t)
    assert read('so: ```json\n{"a": [1]}\n``` ok') == '{"a": [1]}' and read('it is {"a": "}"} then') == '{"a": "}"}'
    assert read('{"a": 1') is None and read("nothing") is None and read('{"a": "x\ty"}') == '{"a": "x\\ty"}'
    assert read('{"a\n": "x\r\ny\x01 \\" z",\n"b": 2}') == '{"a\\n": "x\\r\\ny\\u0001 \\" z",\n"b": 2}'


def test_robots(spark):
    body = "# c\nUser-agent: *\nDisallow: /\n\nUser-agent: other\nUser-agent: Way\nDisallow: /a\nAllow: /a\nAllow: /a/b # deep\nDisallow:"
    rules = crawl.robots_rules(spark.createDataFrame([("h", body), ("k", None)], "host string, robots string"))
    urls = spark.createDataFrame([(1, "http://h/z"), (2, "http://h/a/x"), (3, "http://h/a/b/c"), (4, "http://k/"), (5, "http://new/")], "id int, url string")
    assert {r["id"]: r["allowed"] for r in crawl.gate(urls, rules, "Waymark/1").collect()} == {1: True, 2: False, 3: True, 4: True, 5: True}


def test_successors(spark):
    rows = [("e1", "run-2020", 1), ("e2", "run-2022", 2), ("e3", "run-2022", 3), ("e4", "run-2030", 4), ("e5", "run", 5)]
    df = spark.createDataFrame(rows, "entity_id string, slug string, ord int")
    assert {r["entity_id"]: r["successor"] for r in linking.successors(df).collect()} == {"e1": "e3", "e2": "e4", "e3": "e4"}


def test_snapshot_diff_counts_what_it_does_not_list(spark):
    before = spark.createDataFrame([("a", "active", 1), ("b", "active", 1)], "id string, status string, s int")
    after = spark.createDataFrame([("a", "archived", 1)] + [(f"n{i}", "draft", 0) for i in range(5)], "id string, status string, s int")
    got = {tuple(r) for r in lifecycle.snapshot_diff(before, after, "id", ["s"], listed=3).collect()}
    assert got == {("archived", "a", 1), ("removed", "b", 1), ("added", "n0", 1), ("added", "n1", 2), ("added", "n2", 3), ("added", "2 more", 0)}


def test_question_pairs(spark):
    rows = [("o", 0, "When is the race held?"), ("o", 2, "When is the race held this year?"), ("p", 0, "When is the race held?")]
    got = quality.near_duplicate_questions(spark.createDataFrame(rows, "owner_id string, pos long, question string"))
    assert [tuple(r) for r in got.collect()] == [("o", 0, 2)]


def test_splits_sum_to_the_total(spark):
    rows = spark.createDataFrame([(1, 42), (2, 5000)], "id int, total int")
    got = results.splits(rows, "id", 5, 120).collect()
    assert sum(r["part"] for r in got) == 42 and {r["id"] for r in got} == {1}


def test_collections(spark, tmp_path):
    (tmp_path / "c").mkdir()
    for name, body in (("b.json", '{"id": "b", "extra": 1}'), ("a.json", '{"id": "a"}'), ("bad.json", "{nope"), ("o.json", '{"id": "o", "__file": "first"}')):
        (tmp_path / "c" / name).write_text(body)
    schema = T.StructType([T.StructField("id", T.StringType())])
    good, bad = collections.read_json_collection(spark, f"file:{tmp_path}/c", schema)
    assert [(r["id"], r["_ord"]) for r in good.orderBy("_ord").collect()] == [("a", "a.json"), ("b", "b.json"), ("o", "first")]
    assert [r["_ord"] for r in bad.collect()] == ["bad.json"] and collections.strip_meta(good).columns == ["id"]
    assert collections.read_json_collection(spark, f"file:{tmp_path}/none", schema)[0].count() == 0
    collections.write_valid(good, {"short": F.col("id") != "o"}, ["id"], f"file:{tmp_path}/ok", f"file:{tmp_path}/no")
    assert spark.read.parquet(f"file:{tmp_path}/ok").count() == 2 and spark.read.parquet(f"file:{tmp_path}/no").first()["failed_checks"] == ["short"]
    assert collections.describe_schema(spark, schema).first()["field"] == "id"


def test_item_list(spark):
    rows = spark.createDataFrame([("g", 2, "B", "/b"), ("g", 1, "A", "/a")], "g string, rank int, name string, url string")
    made = exports.item_list_json(rows, "g", "rank", "name", "url").first()["json"]
    assert '"position":1,"name":"A"' in made and '"position":2,"name":"B"' in made


def test_streams_equal_their_batch_forms(spark, tmp_path):
    rows = spark.sql("select concat('h', id % 3) as host, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, id * 5) as ts, id % 4 <> 0 as ok, concat('s', id % 7) as slug from range(60)")
    rows.repartition(1).write.parquet(f"file:{tmp_path}/in")
    source = spark.read.parquet(f"file:{tmp_path}/in")
    for name, make in (("daily", health.daily_health), ("sessions", health.activity_sessions)):
        stream = make(spark.readStream.schema(source.schema).parquet(f"file:{tmp_path}/in"))
        out = stream.writeStream.format("memory").queryName(name).outputMode("complete" if name == "daily" else "append")
        out.option("checkpointLocation", f"file:{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        batch = {tuple(r) for r in make(source).collect()}
        got = {tuple(r) for r in spark.table(name).collect()}
        assert got == batch if name == "daily" else got <= batch and got


def test_interval_duplicates_of_any_length(spark):
    import datetime
    import random

    rng, first = random.Random(3), datetime.date(1968, 1, 1)
    rows = []
    for i in range(120):
        start = first + datetime.timedelta(rng.randrange(4000))
        rows.append((f"e{i}", rng.choice("rs"), start, start + datetime.timedelta(rng.choice([0, 0, 1, 2, 31, 45, 400, 3000])), i))
    rows += [("late", "t", datetime.date(2024, 3, 1), datetime.date(2024, 3, 1), 200), ("season", "t", datetime.date(2024, 1, 1), datetime.date(2024, 6, 30), 201)]
    df = spark.createDataFrame(rows, "entity_id string, region_id string, start date, end date, ord int")
    got = {r["entity_id"]: r["duplicate_of"] for r in linking.interval_duplicates(df.filter("ord % 2 = 0"), df.filter("ord % 2 = 1")).collect()}
    want = {}
    for c in rows[::2]:
        hits = [x for x in rows[1::2] if x[1] == c[1] and c[2] <= x[3] and x[2] <= c[3] and (c[3] > c[2] or x[3] > x[2])]
        if hits:
            want[c[0]] = min(hits, key=lambda x: x[4])[0]
    assert got == want and got["late"] == "season"


def test_first_mentions_are_found_inside_brackets_and_quotes(spark):
    texts = [
        (1, "see (Boston Marathon 2024) now\nBoston Marathon", "u9"), (2, 'a "Boston Marathon" and\tParis Night Run, both', "u9"), (3, "ATMBs and xATMB", "u9"), (4, "Twin Hill Race", "u2"),
        (5, "Twin Hill Race", "u3"), (6, "(ZZ) is\n(Q1) first; Oslo Ab!", None), (7, None, None), (8, "boston marathon", None),
    ]
    names = [("u1", "Boston Marathon", 1), ("u1", "ATMB", 1), ("u2", "Twin Hill Race", 2), ("u3", "Twin Hill Race", 3), ("u4", "Paris Night Run", 4), ("u5", "(Q1)", 5), ("u5", "Ab", 5), ("u6", "Z", 6), ("u7", "", 7)]
    docs = spark.createDataFrame(texts, "doc_id int, text string, own_url string")
    got = {tuple(r) for r in linking.first_mentions(docs, spark.createDataFrame(names, "url string, alias string, ord int")).collect()}
    assert got == {
        (1, "u1", 0, "Boston Marathon"), (2, "u1", 0, "Boston Marathon"), (2, "u4", 0, "Paris Night Run"), (3, "u1", 0, "ATMB"), (4, "u3", 0, "Twin Hill Race"),
        (5, "u2", 0, "Twin Hill Race"), (6, "u5", 1, "(Q1)"), (6, "u6", 0, "Z"),
    }


def _run(spark, make, **tables):
    """A registered query over hand-made tables, each a list of rows and a schema."""
    return [tuple(r) for r in make(SimpleNamespace(spark=spark, **{k: spark.createDataFrame(*x) for k, x in tables.items()})).collect()]


def test_queries_cover_their_whole_tables_and_texts(spark):
    assert {r[0] for r in _run(spark, content.c3, orders=([(k,) for k in range(8)], "o_orderkey long"))} == set(range(8))
    long = "first (85/100) " + "word " * 200
    assert _run(spark, content.x6, v_review=([("r", long)], "review_id string, body string")) == [("r", "first " + ("word " * 200).strip())]
    assert _run(spark, content.t12, documents=([(1, "ab " * 50)], "doc_id int, text string")) == [(1, "-".join(["ab"] * 50))]
    sources = [("e", 1, "2024-05-01"), ("e", 3, "2023-01-01")]
    assert _run(spark, lifecycle_plans.a12, v_entity=([("e", "2000-01-01")], "entity_id string, date_s string"), v_source=(sources, "entity_id string, pos int, last_checked string")) == [("e", "2024-05-01")]


def test_same_questions_meet_by_containment(spark):
    from waymark.functions.text import near_duplicate, question_key

    asked = ["How hilly is the course?", "How hilly is the long course today?", "How hilly is the course", "What hilly course?", "How hot is the course?", "How long?", "how hot, hilly is the course", "", None, "hilly course"]
    rows = [(f"c{i}", 1, q) for i, q in enumerate(asked)] + [("c5", 2, "hot springs near start"), ("c5", 3, "hot springs start")]
    faqs = spark.createDataFrame(rows, "owner_id string, pos int, question string")
    got = {(r["first_owner"], r["other_owner"]) for r in quality.same_questions(faqs).collect()}
    a, b = faqs.select("owner_id", question_key(F.col("question")).alias("a")), faqs.select(F.col("owner_id").alias("o"), question_key(F.col("question")).alias("b"))
    pairs = a.crossJoin(b).filter(near_duplicate(F.col("a"), F.col("b")) & (F.size("a.content") <= F.size("b.content"))).filter("owner_id <> o").collect()
    first = {"c2": "c0"}
    assert got == {(first.get(r["owner_id"], r["owner_id"]), first.get(r["o"], r["o"])) for r in pairs}
    assert ("c0", "c0") in got and ("c0", "c1") in got and ("c5", "c5") not in got


def test_every_well_formed_source_is_kept_whole(spark):
    urls = [f"https://example.org/a/long/path/{i}" for i in range(1, 8)]
    rows = [("e", i, u, "news" if i % 2 else "blog") for i, u in enumerate(urls, 1)] + [("e", 8, "no url", "news"), ("e", 0, urls[0], "news")]
    got = sorted(_run(spark, more.x13, v_source=(rows, "entity_id string, pos int, url string, type string")))
    assert got == [("e", i, "news" if i % 2 else "other", u) for i, u in enumerate(urls, 1)]


def test_compound_references_are_reported_and_stripped(spark):
    assert one(spark, text.strip_artifacts(F.col("v")), "Hilly [11-3,11-4] and hot [16-8] but [1, 2].") == "Hilly and hot but [1, 2]."
    reviews = [("ref", "2024 Hilly [11-3,11-4]."), ("list", "2024 road · city · flat · fast"), ("two", "2024 a · b · c\nd · e"), ("none", "2024 fine [1,2]")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    views = SimpleNamespace(
        v_review=frame([(k, "e", b) for k, b in reviews], "review_id string, entity_id string, body string"),
        v_entity=frame([("e", "s", 1, ["t"], "active", "2024-01-01")], "entity_id string, slug string, ord int, tags array<string>, status string, date_s string"),
        v_faq=frame([], "owner_id string, pos int, answer string"), v_source=frame([], "entity_id string, pos int, url string"),
    )
    got = sorted((r["key"], r["rule"], r["severity"]) for r in quality.violations(views).collect())
    assert got == [("list", "V11.facets", "warning"), ("ref", "V11.ref", "error")]
    had = {r[0]: r[2:] for r in _run(spark, content.x7, v_review=(reviews, "review_id string, body string"))}
    assert had["ref"] == (True, False) and had["none"] == (False, False)


def test_closure_of_any_depth(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(16)]
    regions = spark.createDataFrame(rows, "region_id string, parent_region_id string")
    assert hierarchy.closure(regions).filter("region_id = 'n15'").count() == 16
    assert {r["region_id"]: r["root"] for r in hierarchy.roots(regions).collect()} == {f"n{i}": "n0" for i in range(16)}


def test_related_rows_beside_an_entity_with_many(spark):
    pool = [(f"r{i}", "big" if i < 20 else f"e{i}", "c", "n", i, 100 - i) for i in range(26)]
    schema_ = "review_id string, entity_id string, category_id string, region_id string, ord int, score int"
    targets = spark.createDataFrame([("big", "c", "n"), ("e20", "c", "n")], "entity_id string, category_id string, region_id string")
    got = linking.related(targets, spark.createDataFrame(pool, schema_), [F.desc("score"), F.col("ord")], 4, key="review_id").collect()
    found = {e: [r["other"] for r in sorted(got, key=lambda r: r["place"]) if r["entity_id"] == e] for e in ("big", "e20")}
    assert found == {"big": ["r20", "r21", "r22", "r23"], "e20": ["r0", "r1", "r2", "r3"]}


@pytest.mark.parametrize(
    ("name", "known"),
    [("Run (KLSCM)", {"Run (KLSCM)", "KLSCM", "Run"}), ("Run (24th ed.) City", {"Run (24th ed.) City", "Run City"}), ("Run (Air)", {"Run (Air)", "Run"}), ("Go (B2) x", {"Go (B2) x"})],
)
def test_aliases(spark, name, known):
    assert set(one(spark, linking.aliases(F.col("v")), name)) == known


def test_places_in_large_groups_and_ties(spark):
    rows = [("a" if i % 10 else None, i // 3, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, i int").repartition(4)
    got = ranking.placed(df, ["g"], [F.desc("k"), F.asc("i")]).collect()
    for g in ("a", None):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["place"])
        assert [r["place"] for r in mine] == list(range(1, len(mine) + 1)) and {r["total"] for r in mine} == {len(mine)}
        assert [(-r["k"], r["i"]) for r in mine] == sorted((-r["k"], r["i"]) for r in mine)
    assert ranking.placed(df.limit(0), ["g"], [F.asc("i")]).count() == 0
    urls = spark.createDataFrame([(2, "http://h/b"), (1, "http://h/a"), (3, "http://k/")], "page_id int, url string")
    assert {r["page_id"]: r["at_ms"] for r in crawl.fetch_times(urls, 300).collect()} == {1: 0, 2: 300, 3: 0}


def test_schema_issues_by_field_and_item(spark):
    fields = (schema.text("id", pattern="^[a-z]+$"), schema.Field("n", "number", low=0, high=9), schema.Field("to", "list", least=1, items=(schema.text("label"), schema.Field("url", url=True))),
              schema.texts("tags"), schema.Field("score", "record", required=False, items=schema.SCORES), schema.optional("note", most=3), schema.text("gone"))
    rows = [
        ("ok", 5.0, [("a", "http://x.org")], ["t"], (50.0, [("l", 1.0)]), None, 1), ("Bad", 11.0, [], ["", "u"], (101.0, [("", -1.0), (None, None)]), "long one", 2),
        (None, None, None, None, None, "", 3), ("ok", -1.0, [("a", "b"), (None, None)], None, (None, None), None, 4),
    ]
    kind = "id string, n double, to array<struct<label:string,url:string>>, tags array<string>, score struct<overall:double,breakdown:array<struct<label:string,score:double>>>, note string, key int"
    found = schema.quarantined(spark.createDataFrame(rows, kind), fields, "key").collect()
    by = {k: {(r["path"], r["problem"]) for r in found if r["key"] == k} - {("gone", "required")} for k in (1, 2, 3, 4)}
    assert all((k, "gone", "required") in {tuple(r) for r in found} for k in (1, 2, 3, 4)) and by[1] == set()
    assert by[2] == {("id", "pattern"), ("n", "high"), ("to", "few"), ("tags.0", "empty"), ("score.overall", "high"), ("score.breakdown.0.label", "empty"), ("score.breakdown.0.score", "low"),
                     ("score.breakdown.1.label", "required"), ("score.breakdown.1.score", "required"), ("note", "long")}
    assert by[3] == {("id", "required"), ("n", "required"), ("to", "required"), ("note", "empty")} or by[3] == {("id", "required"), ("n", "required"), ("note", "empty")}
    assert by[4] == {("n", "low"), ("to.0.url", "url"), ("to.1.label", "required"), ("to.1.url", "required"), ("score.overall", "required")}
    kept = schema.accepted(spark.createDataFrame(rows, kind), fields[:-1])
    assert [r["id"] for r in kept.collect()] == ["ok"] and "key" not in kept.columns


def test_answers_become_records(spark):
    answers = [
        ("a", "a", "Run", "About", '{"title":" T ","verdict":"V","sections":[{"heading":"H","paragraphs":["Good [1]."]}],"sources":[{"n":1,"label":"L","url":"https://x.org"}],"rating":{"overall":50}}'),
        ("b", "b", "Run", "About", '{"verdict":"V","sections":[{"heading":"H","paragraphs":["Bad [2]."]}],"sources":[{"n":1,"label":"L","url":"https://x.org"}]}'),
        ("c", "c", "Run", "About", "nothing"), ("d", "d", "Run", "About", '{"sections":"none","highlights":["x"]}'),
        ("e", "e", "Run", "About", '{"verdict":"V","sections":[{"heading":"H","paragraphs":["Ok."]}],"sources":[{"n":1,"label":"L","url":"https://x.org"}],"rating":{"overall":500}}'),
    ]
    rows = normalise.parsed(spark.createDataFrame(answers, "entity_id string, slug string, name string, short_description string, json string"))
    got = {r["entity_id"]: (r["outcome"], r["title"]) for r in normalise.gate(normalise.review(rows, "2024-01-01")).collect()}
    assert got == {"a": ("written", "T"), "b": ("uncited", "Run review"), "c": ("no substance", "Run review"), "d": ("no substance", "Run review"), "e": ("invalid", "Run review")}
    assert {r["entity_id"]: r["outcome"] for r in normalise.research(rows, "2024-01-01").collect()} == {"a": "stamped", "b": "stamped", "c": "stamped", "d": "researched", "e": "stamped"}
    assert {r["entity_id"]: r["problems"] for r in normalise.summary_problems(rows).collect()}["c"] == ["response was not a JSON object"]


def test_window_bounds_roll_over():
    assert discovery.window_bounds("2024-01-31", 1) == ("2024-01-31", "2024-03-02") and discovery.window_bounds("2023-01-31", 1)[1] == "2023-03-03"
    assert discovery.window_bounds("2024-11-15", 14)[1] == "2026-01-15"


def test_first_failing_gate(spark):
    base = {"name": "New Run", "category_label": "Full", "region_label": "Town", "date": "2024-05-01", "distance_km": [42.0], "country": "X", "page_url": "https://x.org", "short_description": "d"}
    change = [{}, {"name": " "}, {"name": "Old run"}, {"category_label": "?"}, {"region_label": "?"}, {"country": None}, {"date": "2030-01-01"}, {"distance_km": [5.0]}, {"name": "Other", "date": "2024-06-02"},
              {"name": "Late", "page_url": "none"}, {"name": "new run"}, {"name": "Name", "category_label": "?", "region_label": "?"}]
    names = ["New Run", "x1", "x2", "x3", "x4", "x5", "x6", "x7", "x8", "x9", "x10", "x11"]
    rows = []
    for i, c in enumerate(change):
        r = base | {"name": names[i]} | c
        rows.append((names[i], i, r["name"], r["category_label"], r["region_label"], r["date"], r["distance_km"], r["country"], r["short_description"], None, r["page_url"], "x.org", ["t"]))
    kind = "key string, ord int, name string, category_label string, region_label string, date string, distance_km array<double>, country string, short_description string, source_url string, page_url string, domain string, tags array<string>"
    c = spark.createDataFrame(rows, kind).withColumns({"start": F.to_date("date"), "end": F.to_date("date")})
    old = spark.createDataFrame([("e1", 1, "old-run", "z", "z", "2020-01-01"), ("e2", 2, "fest", "z", "t", "2024-06-01")], "entity_id string, ord int, slug string, category_id string, region_id string, date string")
    old = old.withColumns({"start": F.to_date("date"), "end": F.date_add(F.to_date("date"), 2)})
    cats, regs = spark.createDataFrame([("f", "full ")], "category_id string, label string"), spark.createDataFrame([("t", "TOWN")], "region_id string, label string")
    got = {r["ord"]: r["reason"] for r in discovery.ledger(c, old, cats, regs, ("2024-01-01", "2025-01-01"), [(40.0, None)], "2024-01-01").collect()}
    assert got == {0: None, 1: "name", 2: "slug", 3: "category", 4: "region", 5: "facts", 6: "window", 7: "scope", 8: "duplicate", 9: "schema", 10: "slug", 11: "category"}


def test_evidence_queues_and_lists(spark):
    rows = spark.createDataFrame([(1, ["news"], 0, 0), (2, ["social"], 0, 0), (3, None, 1, None), (4, None, None, None), (5, [], 0, 2)], "i int, t array<string>, q int, e int")
    assert {r["i"]: r["s"] for r in rows.select("i", browse.has_evidence(F.col("t"), F.col("q"), F.col("e")).alias("s")).collect()} == {1: False, 2: True, 3: True, 4: False, 5: True}
    pool = spark.createDataFrame([("a", "2020-01-01", 1, 0, "n"), ("b", "2025-02-01", 2, 0, "n"), ("c", "2025-01-01", 3, 2, "m"), ("d", None, 4, 0, "k")], "entity_id string, date_s string, ord int, material int, region_id string")
    ids = lambda **k: [r["entity_id"] for r in browse.review_queue(pool, "2024-01-01", 3, **k).collect()]
    regions = spark.createDataFrame([("m", "top"), ("n", "top"), ("k", None), ("top", None)], "region_id string, parent_region_id string")
    assert ids() == ["c", "b", "a"] and ids(prefer=True) == ["c"] and ids(region="k", regions=regions) == ["d"] and ids(region="top", regions=regions) == ["c", "b", "a"]
    reviews = spark.createDataFrame([("x", "2024-01-01", None, 7.9, 1), ("y", None, "2024-03-01", None, 2), ("z", "2024-02-01", None, 7.1, 3)], "review_id string, published_at string, last_updated string, rating double, ord int")
    order = lambda s: [r["review_id"] for r in browse.listed_reviews(reviews, s, 9).orderBy("place").collect()]
    assert order("newest") == ["y", "z", "x"] and order("rating-desc") == ["z", "x", "y"] and order("rating-asc") == ["y", "z", "x"]


def test_deadlines(spark):
    rows = [("a", "2024-05-01", "2024-02-01", "open"), ("b", "2024-05-01", "2024-06-01", None), ("c", "2020-05-01", None, "now OPEN"), ("d", "2020-05-01", "soon", "open"), ("e", "2030-01-01", "2029-01-01", "open"), ("f", "2020-05-01", None, "closed")]
    got = {tuple(r) for r in quality.deadlines(spark.createDataFrame(rows, "entity_id string, date string, deadline string, availability string"), "2024-03-01").collect()}
    assert got == {("a", "V4.passed"), ("b", "V4.order"), ("c", "V4.past"), ("d", "V4.past")}


def test_records_without_claims(spark):
    said = "Registration is open now."
    rows = spark.createDataFrame([(f"A hilly run. {said}", ["Fast", said], [("Is registration still open?", "Yes."), ("How far?", f"Ten. {said}"), ("What?", said)], "open")], "ai_summary string, pros array<string>, faqs array<struct<question:string,answer:string>>, registration_status string")
    got = text.without_claims(rows).first().asDict(recursive=True)
    assert got == {"ai_summary": "A hilly run.", "pros": ["Fast"], "faqs": [{"question": "How far?", "answer": "Ten."}]}
    reviews = spark.createDataFrame([(said, [("H", [said]), ("K", [f"Ok. {said}", said])], None)], "dek string, sections array<struct<heading:string,paragraphs:array<string>>>, faqs array<struct<question:string,answer:string>>")
    got = text.without_claims_in_reviews(reviews).first().asDict(recursive=True)
    assert got == {"dek": said, "sections": [{"heading": "K", "paragraphs": ["Ok."]}], "faqs": None}


def test_exports_leave_out_what_is_unknown(spark):
    import json

    kind = "entity_id string, slug string, name string, short_description string, date string, venue string, city string, country string, organizer string, price_range string"
    rows = spark.createDataFrame([("a", "a", "A", "d", "2024-05-01", None, "Town", "Land", "Org", "5"), ("b", "b", "B", "d", None, None, None, "", None, None)], kind)
    docs = {r["entity_id"]: json.loads(r["json"]) for r in exports.entity_json(rows, "https://s.org").collect()}
    assert docs["a"]["location"] == {"@type": "Place", "name": "Town, Land", "address": {"@type": "PostalAddress", "addressLocality": "Town", "addressCountry": "Land"}}
    assert docs["a"]["offers"]["url"] == "https://s.org/e/a" and docs["a"]["startDate"] == "2024-05-01" and docs["a"]["eventAttendanceMode"].endswith("OfflineEventAttendanceMode")
    assert set(docs["b"]) == {"@context", "@type", "name", "description", "url", "eventStatus"}
    assert "eventStatus" not in json.loads(exports.entity_json(rows, "https://s.org", "Hotel").first()["json"])
    trail = spark.createDataFrame([("k", 2, "Leaf", None), ("k", 1, "Top", "/t")], "k string, pos int, label string, href string")
    assert json.loads(exports.breadcrumb_json(trail, "k", "https://s.org").first()["json"])["itemListElement"] == [
        {"@type": "ListItem", "position": 1, "name": "Top", "item": "https://s.org/t"}, {"@type": "ListItem", "position": 2, "name": "Leaf"},
    ]
