"""The pipeline's stages, each against a brute-force version on what the stage before it kept."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import fixtures as fx
from waymark.llm.staging import Stage, shared_path


def passes(text):
    """Whether a text keeps all six rules."""
    t, w = text or "", fx.words(text)
    lines = [x for x in t.split("\n") if fx.words(x)]
    n, chars, repeated = len(w), sum(map(len, w)), fx.repeat_words(w)
    return not (
        n < 20 or 100 * repeated > 30 * n or 100 * sum(c in "#*$%&|<>" for c in t) > 10 * n or 100 * (len(lines) - len(set(lines))) > 30 * len(lines)
        or chars < 2 * n or chars > 20 * n or 100 * sum("A" <= c <= "Z" for c in t) > 50 * chars
    )


def test_empty_tables_and_clashing_columns(spark):
    folder = shared_path(spark, "sf")
    schema = "doc_id long, text string, lang string, source string, n_chars long, dedup string, kept int, listed string, doc string, key long, rep long, version int"
    spark.createDataFrame([(*r, "x", 1, "y", "z", 2, 3, 4) for r in fx.corpus()], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(fx.benchmark(), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for docs in (spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/documents.parquet").filter("1 = 0")):
        stage, some = Stage(spark, "clash"), docs.head(1)
        for name, step in corpus_pipeline.STAGES[:-1]:
            docs = stage.write(step(spark, docs, folder), name)
            assert docs.columns == [x.split()[0] for x in schema.split(", ")]
        assert docs.filter("dedup <> 'x' or kept <> 1 or listed <> 'y' or doc <> 'z' or key <> 2 or rep <> 3 or version <> 4").count() == 0
        assert bool(corpus_pipeline.STAGES[-1][1](spark, docs, folder).count()) == bool(some)


def test_stages(spark):
    folder = shared_path(spark, "sf")
    rows = fx.corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(fx.benchmark(), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    stage, docs, kept = Stage(spark, "test"), spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        columns = docs.columns
        docs = stage.write(step(spark, docs, folder), name)
        after = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is None, r[0], r[1]))
        assert docs.columns == columns
        kept[name] = (before, after)
    before, after = kept["quality_rules"]
    assert after == sorted(((d, t) for d, t in before if passes(t)), key=lambda r: (r[0] is None, r[0], r[1]))
    before, after = kept["near_dedup"]
    classes = fx.classes(before, 5)
    assert [d for d, _ in after] == sorted((d for d in classes if classes[d] == d)) + [None] * sum(d is None for d, _ in before)
    before, after = kept["substring_dedup"]
    cut = fx.kept_words([t for _, t in before])
    want = [(d, " ".join(k) if len(k) < len(fx.words(t)) else t) for (d, t), k in zip(before, cut, strict=True) if k]
    assert after == sorted(want, key=lambda r: (r[0] is None, r[0], r[1]))
    before, after = kept["decontamination"]
    clean = [(d, t) for d, t in before if not ((c := fx.contamination(t, fx.benchmark()))[1] and 20 * c[1] >= c[0])]
    assert after == sorted(clean, key=lambda r: (r[0] is None, r[0], r[1]))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in after)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sum(r["length"] for r in pieces) == tokens
    assert sum(r["length"] for r in corpus_pipeline.run(spark, folder).collect()) == tokens
