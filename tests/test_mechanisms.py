"""Scans, automata, state in streams, record sources and sinks, each against a sequential or brute-force version."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions import facts
from waymark.functions import pages as pages_of
from waymark.operators import automata, crawl, fingerprint, guides, lifecycle, linking, prose, results, scan, schema
from waymark.sources import records
from waymark.streaming import pacing


def fold(rows, gap):
    """at = max(arrival, at before + gap) by host, in the order of (arrival, item)."""
    out, last = [], {}
    for host, item, arrival in sorted(rows, key=lambda r: (r[2], r[1])):
        last[host] = max(arrival, last[host] + gap) if host in last else arrival
        out.append((host, item, arrival, last[host]))
    return out


def test_max_plus_scan_equals_a_fold_on_a_hot_host(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abcd"), i, rng.randrange(20_000)) for i in range(1500)]
    rows += [(None, 2000 + i, 50) for i in range(4)]
    df = spark.createDataFrame(rows, "host string, item long, arrival long").repartition(5)
    got = {tuple(r) for r in lifecycle.releases(df.union(df.limit(20)), 25).select("host", "item", "arrival", "released").collect()}
    assert got == set(fold(rows, 25))


def test_max_plus_scan_with_gaps_of_its_rows(spark):
    rng = random.Random(6)
    rows = [("g", i, None if rng.random() < 0.1 else rng.randrange(500), rng.randrange(9) if rng.random() < 0.9 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "host string, item long, arrival long, gap long")
    got = {r["item"]: r["at"] for r in scan.max_plus(df, ["host"], [F.asc("item")], F.col("arrival"), F.col("gap"), "at").collect()}
    last = None
    for _, item, arrival, gap in rows:
        known = [x for x in (arrival, None if last is None else last + (gap or 0)) if x is not None]
        last = max(known) if known else None
        assert got[item] == last
    assert scan.max_plus(df.filter("1 = 0"), ["host"], [F.asc("item")], F.col("arrival"), F.col("gap"), "at").count() == 0


def test_requests_wait_only_when_they_must(spark):
    df = spark.createDataFrame([("h", 1, 0), ("h", 2, 100), ("h", 3, 5000), ("h", 4, 5001), ("k", 5, 100)], "host string, item long, arrival long")
    got = {r["item"]: r["at"] for r in crawl.throttled(df, ["host"], [F.asc("arrival")], F.col("arrival"), 300, "at").collect()}
    assert got == {1: 0, 2: 300, 3: 5000, 4: 5300, 5: 100}


@pytest.mark.parametrize("chars", [1 << 20, 40])
def test_mentions_equal_a_search_for_each_string(spark, monkeypatch, chars):
    monkeypatch.setattr(automata, "MACHINE_CHARS", chars)
    rng = random.Random(8)
    words = ["ab", "abc", "bca", "c a", "aaaa", "(x)", "é", "😀b", "line\nbreak", "", None, "nowhere", "ab"]
    texts = [(i, "".join(rng.choice(["a", "b", "c", " ", "\n", "(x)", "é", "😀"]) for _ in range(rng.randrange(60)))) for i in range(40)]
    texts += [(100, None), (101, ""), (102, "aaaaaa\naaaa"), (103, "x" * 50_000 + "\nab"), (None, "ab")]
    docs = spark.createDataFrame([(*t, "k") for t in texts], "doc_id long, text string, alias_ string")
    got = {tuple(r) for r in automata.mentions(docs, spark.createDataFrame([(w,) for w in words], "alias string")).select("doc_id", "alias", "paragraph").collect()}
    want = set()
    for i, t in texts:
        for w in {w for w in words if w and "\n" not in w}:
            hits = [n for n, line in enumerate((t or "").split("\n")) if w in line]
            if hits:
                want.add((i, w, hits[0]))
    assert got == want
    names = spark.createDataFrame([], "url string, alias string, ord int")
    assert linking.first_mentions(docs, names).count() == 0


def test_paced_stream_equals_its_batch_form_over_restarts(spark, tmp_path):
    rng, hour, start = random.Random(9), 3_600_000, 1_704_067_200_000
    rows = [(rng.choice("abc"), i, start + rng.randrange(40 * hour)) for i in range(60)]
    rows += [("a", 900 + i, start + 5 * hour) for i in range(3)]  # ties
    rows.sort(key=lambda r: r[2])
    late, end = ("a", 999, start), ("z", 1000, start + 2000 * hour)
    chunks = [rows[:25] + rows[3:5], rows[25:45], [late, *rows[45:]], [end], [("z", 1001, end[2] + hour)]]
    schema = "host string, item long, ms long"
    before = spark.conf.get(pacing.STATE_STORE[0], None)
    spark.conf.set(*pacing.STATE_STORE)
    try:
        for i, chunk in enumerate(chunks):  # a new run from the checkpoint for each chunk
            frame = spark.createDataFrame(chunk, schema).withColumn("ts", F.timestamp_millis("ms")).repartition(1)
            frame.write.mode("append").parquet(f"file:{tmp_path}/in")
            stream = spark.readStream.schema(frame.schema).parquet(f"file:{tmp_path}/in")
            out = pacing.releases(stream, 11 * hour).writeStream.format("parquet").option("path", f"file:{tmp_path}/out")
            out.option("checkpointLocation", f"file:{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(*pacing.STATE_STORE[:1], before) if before else spark.conf.unset(pacing.STATE_STORE[0])
    got = sorted(tuple(r) for r in spark.read.parquet(f"file:{tmp_path}/out").collect())
    batch = spark.createDataFrame([*rows, end], "host string, item long, arrival long")
    want = sorted(tuple(r) for r in lifecycle.releases(batch, 11 * hour).select("host", "item", "arrival", "released").collect())
    assert [r for r in got if r[0] != "z"] == [r for r in want if r[0] != "z"]
    assert len(got) == len(set(got))


def put(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, content in files.items():
        (folder / f"{name}.json").write_text(content, encoding="utf-8")


FIELDS = "__file string, a long, at struct<b: array<double>>, _error string"


def test_record_source_modes(spark, tmp_path):
    put(tmp_path / "in", one='{"a": 1, "at": {"b": [1, 2.5]}, "more": true}', two='{"a": 2.0, "__file": "mine"}', three="[1]", four='{"a": null}')
    put(tmp_path / "in" / "nested", deep='{"a": 9}')
    (tmp_path / "in" / "notes.txt").write_text("no record")
    good = records.read_records(spark, str(tmp_path / "in"), FIELDS, filesPerPartition=2)
    assert sorted(map(tuple, good.collect()), key=str) == sorted(
        [("four.json", None, None, None), ("mine", 2, None, None), ("one.json", 1, ([1.0, 2.5],), None), ("three.json", None, None, None)], key=str
    )
    assert good.rdd.getNumPartitions() == 2
    put(tmp_path / "in", bad='{"a": ', odd='{"a": "x"}', part='{"a": 1.5}', flag='{"a": true}')
    kept = records.read_records(spark, f"file:{tmp_path}/in", FIELDS, mode="quarantine").collect()
    assert sorted(r["__file"] for r in kept if r["_error"]) == ["bad.json", "flag.json", "odd.json", "part.json"] and len(kept) == 8
    with pytest.raises(Exception, match="Invalid record in bad.json"):
        records.read_records(spark, str(tmp_path / "in"), FIELDS).collect()
    with pytest.raises(Exception, match="needs a column _error"):
        records.read_records(spark, str(tmp_path / "in"), "a long", mode="quarantine").collect()
    assert records.read_records(spark, str(tmp_path / "nowhere"), FIELDS).count() == 0


SMALL = (schema.text("slug", least=1), schema.Field("n", "number", required=False, low=0))


def rows_of(spark, path):
    return sorted((r["slug"], r["n"]) for r in records.read_records(spark, path, "slug string, n double").collect())


def test_record_sink_creates_once(spark, tmp_path):
    path, refused = str(tmp_path / "out"), str(tmp_path / "refused")
    send = lambda data, batch: records.write_records(
        spark.createDataFrame(data, "slug string, n double, ord int, extra string").repartition(3), path, SMALL, "slug", [F.col("ord")], batch, refused
    )
    send([("a", 1.0, 2, "x"), ("a", 0.5, 1, "x"), ("b", -1.0, 3, "x"), ("", 1.0, 4, "x"), ("é\n", None, 5, "x")], "first")
    assert rows_of(spark, path) == [("a", 0.5), ("é\n", None)]
    send([("a", 9.0, 1, "x"), ("c", 3.0, 2, "x")], "second")
    for _ in range(2):
        send([("d", 9.0, 1, "x")], "second")  # a batch of that name is there
    assert rows_of(spark, path) == [("a", 0.5), ("c", 3.0), ("é\n", None)]
    assert sorted((r["slug"], r["problem"]) for r in records.read_records(spark, refused, "slug string, problem string").collect()) == [("", "empty"), ("b", "low")]
    lines = [line for f in (tmp_path / "out" / "_staged").iterdir() for line in f.read_text(encoding="utf-8").splitlines()]
    assert not any("extra" in x or "ord" in x for x in lines)


def test_record_sink_under_failed_and_repeated_tasks(spark, tmp_path):
    spark.dataSource.register(records.Records)
    path, flag = str(tmp_path / "out"), str(tmp_path / "failed")

    def fail_late(it):
        import os

        for batch in it:
            yield batch
        if not os.path.exists(flag):  # the first attempt dies when all its rows are out
            open(flag, "w").close()
            os._exit(1)

    frame = spark.range(40, numPartitions=1).selectExpr("concat('s', id) as slug", "cast(id as double) as n")
    options = {"path": path, "batch": "b"}
    broken = frame.mapInArrow(fail_late, frame.schema)
    with pytest.raises(Exception, match=r"."):  # local mode has no second attempts
        broken.write.format("records").mode("append").options(**options).save()
    assert rows_of(spark, path) == []
    broken.write.format("records").mode("append").options(**options).save()
    broken.write.format("records").mode("append").options(**options).save()
    assert rows_of(spark, path) == sorted((f"s{i}", float(i)) for i in range(40))
    records.vacuum(path)
    assert rows_of(spark, path) == sorted((f"s{i}", float(i)) for i in range(40))
    # two attempts of one task: the commit lists one of them
    writer = records.RecordWriter(frame.schema, {"path": str(tmp_path / "twice"), "batch": "x"})
    staged = tmp_path / "twice" / "_staged"
    staged.mkdir(parents=True)
    for name in ("0-1", "0-2"):
        (staged / f"{name}.jsonl").write_text('{"slug": "s", "n": 1}\n')
    writer.commit([records.Staged("_staged/0-2.jsonl", 1)])
    assert rows_of(spark, str(tmp_path / "twice")) == [("s", 1.0)] and records.vacuum(str(tmp_path / "twice")) == 1


def test_record_sink_conflicts(spark, tmp_path):
    writer = lambda batch, at: records.RecordWriter(T.StructType([]), {"path": str(tmp_path / "log"), "batch": batch, "expected": str(at)})
    writer("a", 0).commit([])
    with pytest.raises(records.Conflict):
        writer("b", 0).commit([])
    writer("b", 1).commit([])
    writer("a", 0).commit([])  # known
    assert [e["batch"] for e in records.log_entries(str(tmp_path / "log"))] == ["a", "b"]


def test_composed_hashes_equal_one_fold(spark, monkeypatch):
    def fnv(text):
        h = fingerprint.BASIS
        for c in text.encode():
            h = (h ^ c) * fingerprint.PRIME & fingerprint.MASK
        return h

    rng = random.Random(2)
    for n in (0, 1, 2, 50):
        text = "".join(rng.choice("abcé|xyz019") for _ in range(n))
        raw, cut = text.encode(), rng.randrange(n + 1)
        factor, added = fingerprint.compose([fingerprint.chunk_map(x) for x in (raw[:cut], raw[cut:])])
        lo = fingerprint.BASIS & 255
        assert (factor * (fingerprint.BASIS - lo) + int(added[lo])) & fingerprint.MASK == fnv(text)
    monkeypatch.setattr(fingerprint, "MEMBERS", 7)
    monkeypatch.setattr(fingerprint, "CHUNKS", 3)
    monkeypatch.setattr(guides, "FEW", 5)
    rows = [("big", f"e{i}") for i in range(333)] + [("mid", f"x{i}") for i in range(8)] + [("few", f"y{i}") for i in range(5)]
    got = {r["guide_id"]: (r["n"], r["fingerprint"]) for r in guides.fingerprints(spark.createDataFrame(rows, "guide_id string, entity_id string").repartition(4)).collect()}
    for g in ("big", "mid", "few"):
        ids = sorted(e for x, e in rows if x == g)
        assert got[g] == (len(ids), f"{len(ids)}-{fnv('|'.join(ids)):08x}")


NOTES = (
    schema.text("title"), schema.texts("tags"), schema.Field("body", "list", items=(schema.text("head"), schema.Field("lines", "list"))),
    schema.Field("score", "number", required=False), schema.Field("by", "record", items=(schema.text("name"),)),
)


def test_pieces_of_nested_records(spark):
    kind = "id int, title string, tags array<string>, body array<struct<head:string,lines:array<string>,more:int>>, score double, by struct<name:string>, undeclared string"
    rows = [
        (1, "T", ["a", None, "b"], [("h", ["x", "y"], 1), (None, [], 2), ("i", None, 3)], 1.0, ("Ann",), "z"),
        (2, None, None, None, None, None, None), (3, "U", [], [], None, (None,), None),
    ]
    df = spark.createDataFrame(rows, kind)
    got = {(r["key"], r["path"], r["place"], r["text"]) for r in prose.texts(df, NOTES, "id").collect()}
    want = {
        ("1", "title", "title", "T"), ("1", "tags[0]", "tags[]", "a"), ("1", "tags[2]", "tags[]", "b"), ("1", "body[0].head", "body[].head", "h"),
        ("1", "body[0].lines[0]", "body[].lines[]", "x"), ("1", "body[0].lines[1]", "body[].lines[]", "y"), ("1", "body[2].head", "body[].head", "i"),
        ("1", "by.name", "by.name", "Ann"), ("3", "title", "title", "U"),
    }
    assert got == want
    assert prose.texts(spark.createDataFrame([(1,)], "id int"), NOTES, "id").count() == 0


def test_prose_rules(spark):
    paragraphs = ["Fine [1].", "A <cite index=1", "See [16-8] and [11-3,11-4].", "a · b · c · d", "Cites [2, 9] and [9]."]
    kind = "review_id string, sections array<struct<heading:string,paragraphs:array<string>>>, sources array<struct<n:int,label:string>>, faqs array<struct<question:string,answer:string>>"
    faqs = [("Q", "word " * 30), ("Q", "word " * 81), ("Q", " short\n one ")]
    df = spark.createDataFrame([("r", [("h", paragraphs), ("i", None)], [(1, "a"), (2, "b"), (3, "c")], faqs), ("none", None, None, None)], kind)
    got = list((r["key"], r["path"], r["rule"], r["severity"], r["detail"]) for r in prose.violations(df, "review", "review_id").collect())
    at = lambda i: f"sections[0].paragraphs[{i}]"
    assert sorted(got, key=str) == sorted([
        ("r", at(1), "V11.cite", "error", None), ("r", at(2), "V11.ref", "error", None), ("r", at(3), "V11.facets", "warning", None), ("r", at(4), "V12.unresolved", "error", "9"),
        ("r", at(4), "V12.unresolved", "error", "9"), ("r", "sources[2]", "V12.uncited", "warning", "3"), ("r", "faqs[1].answer", "V7.answer", "warning", None), ("r", "faqs[2].answer", "V7.answer", "warning", None),
    ], key=str)
    entity = spark.createDataFrame([("e", "Verified as of 2 May 2024.", ["fine", "a confidence score of 92"])], "entity_id string, ai_summary string, cons array<string>")
    assert sorted(r["path"] for r in prose.violations(entity, "entity", "entity_id").collect()) == ["ai_summary", "cons[1]"]


def test_open_facts_keep_their_types(spark):
    texts = ['{"a":{"b":5}}', '{"a":{"b":"5"}}', '{"a":{"b":null}}', "{}", '{"a":{"b":[5,"x"]}}', '{"a":{"b":true}}', '{"a":{"b":"z"}}', '{"a":[{"b":7}]}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.expr("parse_json(t)").alias("core_facts"))
    hold = lambda op, x, field="a.b": [r["i"] for r in df.filter(facts.holds(facts.value_of(df, field), op, x)).orderBy("i").collect()]
    assert hold("eq", 5) == [0] and hold("eq", "5") == [1] and hold("eq", None) == [2] and hold("eq", True) == [5] and hold("eq", 1) == []
    assert hold("neq", 5) == [1, 2, 3, 4, 5, 6, 7, 8] and hold("in", [5, "z", None]) == [0, 2, 6] and hold("in", "5") == []
    assert hold("gte", 5) == [0, 1] and hold("lt", 2) == [2, 5] and hold("gt", "4") == [0, 1, 6] and hold("lt", "y") == [1]
    assert hold("contains", 5) == [0, 1, 4] and hold("contains", "x") == [4] and hold("contains", "") == [0, 1, 2, 3, 5, 6, 7, 8]
    assert hold("eq", 7, "a.0.b") == [7] and hold("neq", 1, "it's") == list(range(9)) and hold("no-such", 1) == list(range(9))


@pytest.mark.parametrize("top", [10_000, 2])
def test_guides_sort_mixed_types(spark, monkeypatch, top):
    monkeypatch.setattr(guides, "TOP", top)
    values = ["3", '"b"', '"a"', "null", "10", None, "true", '"B"']
    rows = [(f"e{i}", "r", "c", "active", [1.0], ["t"], i, "{}" if v is None else f'{{"v":{v}}}') for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "entity_id string, region_id string, category_id string, status string, numeric_facts array<double>, tags array<string>, ord int, f string")
    entities = df.withColumn("core_facts", F.expr("parse_json(f)")).withColumn("day", F.expr("date'2024-01-01' + ord % 3"))
    regions = spark.createDataFrame([("r", None, "country")], "region_id string, parent_region_id string, granularity string")
    cats = spark.createDataFrame([("c", 1.0, None, 1)], "category_id string, min_v double, max_v double, ord int")
    specs = [{"id": "up", "sort_by": "v", "descending": False}, {"id": "down", "sort_by": "v"}, {"id": "five", "sort_by": "v", "limit": 5}, {"id": "day", "sort_by": "day", "limit": 4}]
    got = {}
    for r in sorted(guides.resolve(entities, regions, cats, specs).collect(), key=lambda r: (r["guide_id"], r["rank"])):
        got.setdefault(r["guide_id"], []).append(int(r["entity_id"][1:]))
    assert got["up"] == [6, 0, 4, 7, 2, 1, 3, 5] and got["down"] == [1, 2, 7, 4, 0, 6, 3, 5]
    assert got["five"] == got["down"][:5] and got["day"] == [2, 5, 1, 4]
    assert guides.resolve(entities, regions, cats, []).count() == 0


def test_rejected_changes_leave_all_facts(spark):
    changes = ['{"date":"2025-02-02"}', '{"distance_km":[-1]}', '{"date":null}', '{"nothing":1}', "{}", '{"distance_km":"far"}', '{"date":"2024-01-01"}', '{"date":7}', None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(changes)], "i int, c string").select(
        "i", F.struct(F.lit("2024-01-01").alias("date"), F.array(F.lit(5.0)).alias("distance_km"), F.lit("X").alias("country")).alias("facts"), F.expr("parse_json(c)").alias("changes")
    )
    got = {r["i"]: (r["facts"]["date"], r["facts"]["distance_km"], r["accepted"], r["changed"]) for r in lifecycle.merged_facts(df, schema.FACTS["races"]).collect()}
    old = ("2024-01-01", [5.0])
    assert got[0] == ("2025-02-02", [5.0], True, True) and got[6] == (*old, True, False) and got[3] == (*old, True, False)
    assert all(got[i] == (*old, False, False) for i in (1, 2, 5, 7)) and got[4] == got[8] == (*old, None, False)
    lacking = df.withColumn("facts", F.col("facts").dropFields("country"))
    assert not any(r["accepted"] for r in lifecycle.merged_facts(lacking, schema.FACTS["races"]).collect())


def test_observed_counters_equal_a_recount(spark):
    rows = spark.range(100).selectExpr("id", "case id % 4 when 0 then 'a' when 1 then 'b' when 2 then 'c' end as outcome")
    table, counted = lifecycle.observed(rows, "run", ["a", "b"], "observed")
    assert {(r["run"], r["outcome"], r["n"]) for r in counted.collect()} == {("run", "a", 25), ("run", "b", 25), ("run", "other", 50)} and table.count() == 100


def test_pages_are_clamped(spark):
    pages = spark.createDataFrame([("a", 50)] * 50 + [("b", 1), ("c", 24)], "g string, total int")
    wanted = spark.createDataFrame([("a", 0), ("a", 2), ("a", 3), ("a", 9), ("b", 5), ("c", 1), ("d", 2)], "g string, wanted int")
    got = {(r["g"], r["wanted"]): (r["page"], r["line"]) for r in lifecycle.page_view(pages, wanted, "g", 24).collect()}
    assert got["a", 0] == (1, "Showing 1-24 of 50 reviews") and got["a", 2][1] == "Showing 25-48 of 50 reviews" and got["a", 3] == got["a", 9] == (3, "Showing 49-50 of 50 reviews")
    assert got["b", 5] == (1, "1 review") and got["c", 1] == (1, "24 reviews") and got["d", 2] == (1, "")


def test_links_of_pages_without_an_address(spark):
    rows = [("/a", "HTTPS://Ex.org/x"), ("b", None), ("b", "nowhere"), ("//h/c", "http://e.org"), ("mailto:x@y.z", None), ("?q", "https://e.org/p")]
    df = spark.createDataFrame(rows, "h string, b string")
    got = [r["u"] for r in df.select(pages_of.absolute(F.col("h"), F.col("b")).alias("u")).collect()]
    assert got == ["HTTPS://Ex.org/a", None, None, "http://h/c", "mailto:x@y.z", "https://e.org/p?q"]


def test_age_factors_and_tiers(spark):
    ages = [5, 18, 20, 25, 35, 45, 55, 65, 75, 110]
    df = spark.createDataFrame([(float(a),) for a in ages], "a double")
    got = [round(r["f"], 6) for r in df.select(results.age_factor(F.col("a")).alias("f")).collect()]
    assert got == [0.849, 0.979, 0.985, 1.0, 1.0, 0.94, 0.865, 0.755, 0.6, 0.15]
    classes = [r["c"] for r in df.select(results.tier(F.col("a"), results.AGE_CLASSES, "rest").alias("c")).collect()]
    assert classes == ["rest"] * 6 + ["recreational", "regional", "national", "world"]
