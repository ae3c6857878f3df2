"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item becomes windows of WINDOW consecutive words (an item of fewer words is one window). Words
are ordered by rarity over all documents; exact containment needs every word of a window, so its rarest word alone
is its necessary prefix. A document's occurrences of prefix words meet the windows they stand for in a join; the
positional bound (the window must start at or after the first word) and the length bound (and end by the last one)
prune candidates, and the words around the occurrence, carried along, verify the window exactly.

Prefix words that fit PREFIXES_INLINE are tested inside the document's row, so only their occurrences leave it;
a larger benchmark joins all positions, with a shuffle. Both ways give the same rows. The windows are broadcast
only up to WINDOWS_BROADCAST.

Only built-in functions are used. Defined results: a null text has no words and is clean; an item without words has
no window; repeated items and documents count one by one; a null item_id counts as no item in the list; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.staging import Stage, without
from waymark.llm.text import NOT_ALNUM, lower_ascii, pieces

WINDOW = 13
PREFIXES_INLINE, WINDOWS_BROADCAST = 20_000, 100_000


def version(text: Column) -> Column:
    """Tells rows that share a doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _words(text: str) -> Column:
    return F.transform(pieces(F.col(text), NOT_ALNUM), lower_ascii)


def windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct windows as `w` with the items they come from."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), _words("text").alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    cut = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, width))).alias("w"))
    return cut.groupBy("w").agg(F.collect_set("item_id").alias("items"))


def document_counts(docs: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """How often each word of the vocabulary occurs in all documents; summed before the shuffle."""
    words = docs.select(F.explode(pieces(F.col("text"), NOT_ALNUM)).alias("word")).select(lower_ascii(F.col("word")).alias("word"))
    side = F.broadcast(vocabulary) if small else vocabulary
    return words.join(side, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))


def prefix_index(wins: DataFrame, docs: DataFrame, small: bool, stage: Stage) -> DataFrame:
    """word -> (offset, w, items): each window under its rarest word, ties by the word."""
    listed = wins.select("w", "items", F.posexplode("w").alias("offset", "word"))
    vocabulary = listed.select("word").distinct()
    # written, so that the join is one of two plain shuffles, which Spark can split
    counts = stage.write(document_counts(docs, vocabulary, small), "counts")
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")
    best = listed.join(counts, "word", "left").groupBy("w").agg(F.min(rarity).alias("r"), F.first("items").alias("items"))
    # a window with a word that no document has can't occur
    return best.filter("r.n > 0").select(F.col("r.word").alias("word"), F.col("r.offset").alias("offset"), "w", "items")


def occurrences(docs: DataFrame, prefixes: list[str] | None, width: int) -> DataFrame:
    """row, doc_id, n_words and, for each occurrence of a prefix word, its place and the words around it."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", version(F.col("text")).alias("version"), _words("text").alias("t"))
    t = F.col("t")
    places = F.when(F.size("t") > 0, F.sequence(F.lit(0), F.size("t") - 1)).otherwise(F.array().cast("array<int>"))
    if prefixes is not None:
        places = F.filter(places, lambda i: F.get(t, i).isin(prefixes)) if prefixes else F.array().cast("array<int>")
    first = lambda i: F.greatest(i - (width - 1), F.lit(0))
    around = F.transform(places, lambda i: F.struct(i.alias("i"), F.get(t, i).alias("word"), first(i).alias("first"), F.slice(t, first(i) + 1, 2 * width - 1).alias("near")))
    return rows.select("row", "doc_id", "version", F.size("t").cast("long").alias("n_words"), F.explode_outer(around).alias("o"))


def _covered(spans: Column) -> Column:
    """Words in the union of sorted (start, length) spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, s: F.struct(
        F.greatest(a["end"], s["start"] + s["len"]).alias("end"),
        (a["n"] + F.greatest(s["start"] + s["len"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n"),
    )
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and version (of the text) for every document."""
    stage = Stage(docs.sparkSession, "benchmark")
    wins = stage.write(windows(benchmark, width), "windows")
    small = wins.count() <= WINDOWS_BROADCAST
    # written once: its rarity counts take a pass over all documents
    index = stage.write(prefix_index(wins, docs, small, stage), "index")
    stage.drop("counts", "windows")
    prefixes = None
    if small:
        found = [r[0] for r in index.select("word").distinct().collect()]
        prefixes = sorted(found) if len(found) <= PREFIXES_INLINE else None
    near = occurrences(docs, prefixes, width).select("row", "doc_id", "version", "n_words", "o.*")
    start = F.col("i") - F.col("offset")
    size = F.size("w")
    bounds = (start >= 0) & (start + size <= F.col("n_words"))
    exact = F.slice("near", F.greatest(start - F.col("first") + 1, F.lit(1)), size) == F.col("w")
    side = (F.broadcast(index) if small else index).withColumnRenamed("word", "prefix")
    hits = near.join(side, (F.col("word") == F.col("prefix")) & bounds & exact, "left")
    span = F.when(F.col("w").isNotNull(), F.struct(start.alias("start"), size.alias("len")))
    by_doc = hits.groupBy("row", "doc_id", "version", "n_words").agg(F.collect_set(span).alias("spans"), F.collect_set("items").alias("items"))
    ids = F.array_sort(F.array_distinct(F.flatten("items")))
    n_hit = _covered(F.sort_array("spans")).cast("long")
    return by_doc.select("doc_id", "version", "n_words", n_hit.alias("n_hit"), ids.alias("ids")).select(
        "doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "version",
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    found = contamination(docs, benchmark, width).filter("contaminated").select("doc_id", "version")
    same = F.col("doc.doc_id").eqNullSafe(F.col("listed.doc_id")) & (version(F.col("doc.text")) == F.col("listed.version"))
    return without(docs, found, same, Stage(docs.sparkSession, "contaminated"))
