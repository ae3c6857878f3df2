"""Work that must not be repeated or grow faster than the input: plans and sizes on hand-made records."""

import random
import tempfile
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from waymark.functions import facts, text
from waymark.operators import browse, guides, linking, normalise, quality, schema
from waymark.plans import records
from waymark.plans.views import AS_OF, Views
from waymark.sources import records as sources
from waymark.sources.staged import remove, shared_folder

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def nodes(df):
    root, i = df._jdf.queryExecution().optimizedPlan(), 0
    while (node := root.apply(i)) is not None:
        yield node
        i += 1


def columns(node):
    return [node.output().apply(i).name() for i in range(node.output().size())]


def test_an_answer_is_read_once(spark):
    rows = [(1, '{"ai_summary":"x","short_description":"y","pros":["a"],"cons":[],"faqs":[{"question":"q","answer":"one two"},{"question":"","answer":"z"}]}'), (2, "no"), (3, None)]
    answers = spark.createDataFrame(rows, "ord int, json string")
    found = normalise.problem_rows(normalise.parsed(answers))
    assert plan(found).count("from_json") == 1
    assert sorted(map(tuple, found.collect())) == [(1, "a faq entry is missing question/answer"), (1, "faq answer is 2 words"), (2, normalise.NO_OBJECT), (3, normalise.NO_OBJECT)]
    assert plan(__spark_entry__.queries()["V15_summary_problems"](spark, SMALL)).count("from_json") == 1


def test_answers_are_dealt_out_before_they_are_read(spark):
    assert "RepartitionByExpression" in plan(__spark_entry__.queries()["V15_summary_problems"](spark, SMALL))


def test_the_sitemap_holds_every_region_with_entities(spark):
    paths = {r["path"] for r in __spark_entry__.queries()["S8_sitemap"](spark, SMALL).filter("path like '/regions/%'").collect()}
    assert {"/regions/root", *(f"/regions/r{i}" for i in range(5))} <= paths


def test_copies_of_an_interval_meet_once(spark):
    rows = lambda n, at: spark.createDataFrame([(f"{at}{i}", i, "r", "2024-01-01", "2024-01-02") for i in range(n)], "entity_id string, ord int, region_id string, start string, end string")
    days = lambda df: df.withColumns({c: F.to_date(c) for c in ("start", "end")})
    found = linking.interval_duplicates(days(rows(300, "c")), days(rows(300, "x")))
    assert {tuple(r) for r in found.collect()} == {(f"c{i}", "x0") for i in range(300)}
    joins = [j for j in rows_of_joins(found) if j > 0]
    assert joins and max(joins) <= 300


def rows_of_joins(df):
    """Rows that each join of a plan that has run gave."""
    def walk(p):
        if p.nodeName() == "AdaptiveSparkPlan":
            p = p.executedPlan()
        if p.nodeName().endswith("QueryStage") or "QueryStage" in p.nodeName():
            p = p.plan()
        if "Join" in p.nodeName():
            yield int(p.metrics().apply("numOutputRows").value())
        children = p.children()
        for i in range(children.size()):
            yield from walk(children.apply(i))

    return list(walk(df._jdf.queryExecution().executedPlan()))


def test_a_guides_values_and_matches_are_made_once(spark):
    rows = spark.createDataFrame([(f"e{i}", i, "r", "c", "active", ["t"], [1.0], f'{{"a": {i}}}') for i in range(5)], "entity_id string, ord int, region_id string, category_id string, status string, tags array<string>, numeric_facts array<double>, j string")
    rows = rows.withColumn("core_facts", F.parse_json("j")).drop("j")
    regions = spark.createDataFrame([("r", None, "city")], "region_id string, parent_region_id string, granularity string")
    categories = spark.createDataFrame([("c", "C", 0.0, None, 1)], "category_id string, label string, min_v double, max_v double, ord int")
    found = guides.resolve(rows, regions, categories, [{"id": "g", "facts": [("a", "gt", 1), ("a", "lt", 9)], "sort_by": "a", "limit": 2}, {"id": "h", "facts": [("a", "eq", 3)], "limit": 2}])
    assert plan(found).count("try_variant_get(core_facts") + plan(found).count("variantGet(core_facts") <= 1 and plan(found).count("'g'") + plan(found).count(" g AS guide_id") <= 1
    assert sorted(map(tuple, found.collect())) == [("g", 1, "e4"), ("g", 2, "e3"), ("h", 1, "e3")]


def test_scrubbing_splits_a_text_once(spark):
    rows = spark.createDataFrame([("Entries are closed. They reopen in May. That is it. A race, and registration is open!",), ("Registration is open.",), ("",)], "t string")
    out = rows.select(text.scrub(F.col("t")).alias("t"))
    assert plan(out).count("split(") == 1
    assert [r["t"] for r in out.collect()] == ["Entries are closed. They reopen in May. That is it.", "Registration is open.", ""]


def test_issues_are_made_once(spark):
    found = schema.quarantined(spark.createDataFrame([("a", "x"), ("b", None)], "k string, label string"), (schema.text("label", pattern="^y$"),), "k")
    assert plan(found).count("RLIKE") + plan(found).count("rlike") == 1
    assert sorted(map(tuple, found.collect())) == [("a", "label", "pattern"), ("b", "label", "required")]


def test_run_counters_read_an_answer_once(spark):
    v = Views(spark, SMALL)
    found = records._answered(v)
    assert plan(found).count("from_json") == 1
    answers = normalise.parsed(v.v_reply)
    apart = normalise.research(answers, AS_OF).groupBy("outcome").count().collect(), normalise.gate(normalise.review(answers, AS_OF)).groupBy("outcome").count().collect()
    assert [sorted(map(tuple, found.groupBy(c).count().collect())) for c in ("research", "reviews")] == [sorted(map(tuple, x)) for x in apart]


def test_orders_are_dealt_out_before_entities_are_matched(spark):
    assert "RepartitionByExpression" in plan(Views(spark, SMALL).v_entity)


def test_kinds_of_open_facts_are_found_once(spark):
    rows = spark.createDataFrame([(1, '{"a": [1, "x"], "b": 2}'), (2, '{"a": "x1", "b": "y"}'), (3, "{}")], "ord int, j string").select("ord", F.parse_json("j").alias("core_facts"))
    made, values = facts.values_of(rows, [("a", False), ("b", False), ("b", True)], {"a"})
    assert plan(made.select("ord", *(values[w].number for w in values), values["b", True].text.alias("t"), facts.holds(values["b", False], "gt", 1).alias("g"))).count("schema_of_variant") <= 2
    hit = made.select("ord", facts.holds(values["a", False], "contains", "x").alias("a"), facts.holds(values["b", False], "eq", 2).alias("b"))
    assert sorted(map(tuple, hit.collect())) == [(1, True, True), (2, True, False), (3, False, False)]


def test_only_answers_about_listed_entities_are_read(spark):
    found = plan(__spark_entry__.queries()["A17_guide_tallies"](spark, SMALL))
    assert found.count("LeftSemi") == 1 and found.count("from_json") == 1


def test_briefs_and_summaries_resolve_the_guides_once(spark):
    for name in ("A10_guide_summaries", "A11_guide_briefs"):
        assert "lineitem" not in plan(__spark_entry__.queries()[name](spark, SMALL)) and "l_orderkey" not in plan(__spark_entry__.queries()[name](spark, SMALL))


def test_related_entities_derive_their_pool_once(spark):
    assert "l_orderkey" not in plan(__spark_entry__.queries()["J10_related_entities"](spark, SMALL))


def test_chips_pass_over_the_entities_once(spark):
    v = Views(spark, SMALL)
    assert plan(browse.chips(v.v_entity, v.v_category)).count("l_linestatus) AS") <= 1 and "Union" not in plan(browse.chips(v.v_entity.select("entity_id", "tags", "category_id", "numeric_facts", "region_id"), v.v_category.limit(2)))
    none = v.v_entity.limit(1).withColumns({"tags": F.lit(None).cast("array<string>"), "region_id": F.lit(None).cast("string")})
    assert None in {r["chip"] for r in browse.chips(none, v.v_category).collect()}


def test_the_sink_gets_texts_that_the_engine_made():
    written_as = []
    writer = sources.RecordWriter.__new__(sources.RecordWriter)
    writer.names, writer.path = [sources.TEXT], tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sources.TaskContext, kept = type("At", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": lambda s: 0, "taskAttemptId": lambda s: 0})())}), sources.TaskContext
    try:
        written_as.append(writer.write(iter([('{"a":"é"}',)])))
    finally:
        sources.TaskContext = kept
    assert open(f"{writer.path}/{written_as[0].name}", encoding="utf-8").read() == '{"a":"é"}\n'


def test_sources_of_a_listing_travel_as_numbers(spark):
    v = Views(spark, SMALL)
    found = records.listing(v)
    lists = [columns(node.children().apply(0)) for node in nodes(found) if node.nodeName() == "Aggregate" and "collect_list" in node.toString().splitlines()[0]]
    assert lists and not any("url" in x or "entity_id" in x for x in lists)
    joins = [node.toString().splitlines()[0] for node in nodes(found) if node.nodeName() == "Join"]
    assert joins and not any("entity_id" in x for x in joins)
    apart = v.v_source.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("pos", "url", "type", "last_checked"))).alias("s"))
    got = found.select("entity_id", F.transform("source_mix", lambda x: F.struct(x["url"], x["type"], x["last_checked"])).alias("s"))
    want = apart.join(v.v_listing, "entity_id").select("entity_id", F.transform("s", lambda x: F.struct(x["url"], x["type"], x["last_checked"])).alias("s"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect()))) and {r["label"] for r in found.select(F.inline("source_mix")).collect()} == {"page"}


def files_of(folder):
    return [p for p in Path(folder).rglob("*") if p.is_file()]


def test_batches_of_the_sink_are_judged_once_and_leave_no_tables(spark, monkeypatch):
    calls, made, issues = [], [], sources.rules.issues
    monkeypatch.setattr(sources.rules, "issues", lambda *a: calls.append(a) or issues(*a))
    shared = records.shared_path
    monkeypatch.setattr(records, "shared_path", lambda *a: made.append(shared(*a)) or made[-1])
    before = set(Path(urlparse(shared_folder(spark)).path).glob("waymark-judged-*"))
    assert __spark_entry__.queries()["S3_S4_record_sink"](spark, SMALL).count() > 0
    assert len(calls) == 1 and set(Path(urlparse(shared_folder(spark)).path).glob("waymark-judged-*")) == before
    # every issue of both batches is in quarantine, compressed
    path = urlparse(made[0]).path
    refused = sources.read_records(spark, f"{path}/refused", "slug string, path string, problem string")
    judged = issues(records.listing(Views(spark, SMALL)), schema.ENTITY).select("ord", "slug", F.inline("issues"))
    want = judged.drop("ord").union(judged.filter("ord % 2 = 0").drop("ord"))
    assert sorted(map(str, map(tuple, refused.collect()))) == sorted(map(str, map(tuple, want.collect())))
    held = sum(len(str(tuple(r))) for r in refused.collect())
    assert sum(p.stat().st_size for p in files_of(f"{path}/refused/_staged")) < held / 3


def test_a_judged_table_holds_no_fields_of_refused_records(spark, tmp_path):
    fields = (schema.text("slug", least=1), schema.Field("n", "number", required=False, low=0))
    rows = spark.createDataFrame([(f"s{i}", float(i % 2 - 1), i, "x" * 50) for i in range(20)] + [("s1", 5.0, 99, "y")], "slug string, n double, `or.d` int, more string")
    at, table = sources.judged(rows, fields, ["slug"])
    assert {(r["_record"] is None, len(r["issues"])) for r in table.collect()} == {(True, 1), (False, 0)}
    remove(spark, at)
    for codec in (None, "zstd", "gzip"):
        path = str(tmp_path / f"out-{codec}")
        for batch in ("a", "b", "a"):
            sources.write_records(rows, path, fields, "slug", [F.desc("`or.d`")], batch, f"{path}-refused", codec)
        assert sorted(map(tuple, sources.read_records(spark, path, "slug string, n double").collect())) == sorted([(f"s{i}", 0.0) for i in range(3, 20, 2)] + [("s1", 5.0)])
        assert sources.read_records(spark, f"{path}-refused", "slug string").count() == 20
        ends = {"".join(p.suffixes) for p in files_of(f"{path}/_staged") if not p.name.startswith(".")}
        assert ends == {".jsonl" + sources.ENDS.get(codec, "")}
    with pytest.raises(Exception, match="compression lz"):
        sources.write_records(rows, str(tmp_path / "odd"), fields, "slug", [F.col("n")], "a", str(tmp_path / "odd-refused"), "lz")


def test_partitions_of_compressed_files_are_of_what_they_hold(tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "BYTES", 100)
    for i in range(4):
        (tmp_path / f"{i}.jsonl.zst").write_bytes(b"x" * 9)
        (tmp_path / f"{i}.jsonl").write_bytes(b"x" * 9)
    parts = lambda glob: len(sources.RecordReader(T.StructType([]), {"path": str(tmp_path), "glob": glob}).partitions())
    assert (parts("*.jsonl"), parts("*.zst")) == (1, 4)


def test_words_of_questions_travel_without_them(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    asked = [" ".join(rng.choices(words, k=rng.choice([2, 3, 4, 9]))) for _ in range(150)] + [" ".join(f"x{i}" for i in range(n)) for n in (2, 90, 200)] + ["Is w1 w2 so?", "", None]
    owners = [None if i % 11 == 0 else f"c{i % 40}" for i in range(len(asked))]
    faqs = spark.createDataFrame(list(zip(owners, asked, strict=True)), "owner_id string, question string")
    found = quality.same_questions(faqs)
    spread = [node for node in nodes(found) if node.nodeName() == "Generate"]
    assert spread and not any("content" in columns(node) for node in spread)
    # the same by comparing every two groups
    groups = {}
    for owner, k in faqs.select("owner_id", text.question_key(F.col("question")).alias("k")).collect():
        if len(k["content"]) >= 2:
            groups.setdefault((k["lead"], tuple(sorted(k["content"]))), []).append(owner)
    known = {g: (len(of), min(filter(None, of), default=None), max(filter(None, of), default=None)) for g, of in groups.items()}
    other = lambda x, y: None not in (x, y) and x != y  # noqa: E731  as SQL has it: an unknown owner is no other one
    differ = lambda a, b: other(*a[1:]) or other(*b[1:]) or other(a[1], b[1])
    pairs = [(a, b) for a in known for b in known if a[0] == b[0] and set(a[1]) <= set(b[1]) and differ(known[a], known[b])]
    want = [(a[0], " ".join(a[1]), *known[a][:2], " ".join(b[1]), *known[b][:2]) for a, b in pairs]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want)) and len(want) > 100
