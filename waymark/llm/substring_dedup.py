"""Exact removal of passages that occur more than once, over a compacted De Bruijn graph of word windows.

The edges of the graph are the windows of WINDOW consecutive words. Neighbouring windows of a text that share
their least k-mer (of MINIMIZER words, the leftmost of equals) form a path; equal windows always lie in paths with
an equal k-mer, so paths, about one for every thirteen windows, stand for them in the shuffle. If all paths of a
k-mer are equal (the graph doesn't branch there), the path is a compact edge. Compact edges that occur twice are joined
to their neighbours: where one is always followed by the other, and the other always follows it, pointer doubling
over Spark joins makes one long edge of the whole chain. Paths of k-mers where different ones meet are expanded to windows.

64-bit hashes only choose candidates. Source coordinates (document, first window, number of windows) lead back to the
words: each candidate, long edge or single window, is named by the 128-bit BLAKE2 digest of its words as they stand in the
source, and is repeated if two places give one digest.

Counts are summed before the shuffle and written; rows meet them in joins of two plain shuffles, which Spark can split,
so a passage in a third of all documents is no hot task. Intermediate tables are dropped when they have been read.

Defined results: a null or empty text has no words; texts of fewer words than a window lose nothing; rows without
doc_id are documents like others; repeated rows are occurrences of their own, so both lose their windows; all columns of
the input are kept, whatever their names (remove_repeats replaces one called `dedup`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.pieces import trim
from waymark.llm.staging import ROWS_BROADCAST, Stage, release, short
from waymark.llm.text import hashes, words

WINDOW, MINIMIZER = 35, 11
#: Words of a batch that arrays are made for at once; a longer text is a batch of its own.
BATCH_WORDS = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """BASE and its inverse to the powers 0 to n - 1 and more, modulo 2^64; one table that grows as needed."""
    if len(_POWERS[0]) < n:
        for k, b in enumerate((BASE, INVERSE)):
            p = np.full(1 << n.bit_length(), b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


class Hashes:
    """Hashes of any run of words of a flat array of word hashes."""

    def __init__(self, h: np.ndarray):
        up, self.down = _powers(len(h) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)))

    def of(self, first: np.ndarray, size) -> np.ndarray:
        return _mix((self.sums[first + size] - self.sums[first]) * self.down[first])


def _least(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Value and place of the leftmost least of each n neighbours."""
    place, done = np.arange(len(x)), 1
    while done < n:
        step = min(done, n - done)
        right = x[step:] < x[:-step]
        x, place = np.where(right, x[step:], x[:-step]), np.where(right, place[step:], place[:-step])
        done += step
    return x, place


def paths(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts whose word hashes lie in h at offsets: first window (place in h), number of windows, k-mer and
    hash of the words of each path."""
    total = len(h)
    if total < WINDOW:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    run = Hashes(h)
    kmers = run.of(np.arange(total - MINIMIZER + 1), MINIMIZER)
    value, place = _least(kmers, WINDOW - MINIMIZER + 1)
    valid = np.zeros(total - WINDOW + 2, np.int64)
    sizes = np.diff(offsets)
    some = sizes >= WINDOW
    valid[offsets[:-1][some]] += 1
    valid[offsets[1:][some] - WINDOW + 1] -= 1
    at = np.flatnonzero(np.cumsum(valid)[:-1] > 0)
    if not len(at):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    starts = np.concatenate(([True], (np.diff(place[at]) != 0) | (np.diff(at) != 1)))
    starts |= np.isin(at, offsets[:-1], assume_unique=False) if len(offsets) > 1 else False
    first = np.flatnonzero(starts)
    n = np.diff(np.concatenate((first, [len(at)])))
    begin = at[first]
    return begin, n, value[begin], run.of(begin, n + WINDOW - 1)


def _parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BATCH_WORDS words."""
    at, size = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > at and size + s > BATCH_WORDS:
            yield at, i
            at, size = i, 0
        size += s
    if at < len(sizes):
        yield at, len(sizes)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False), offsets


_PATHS = "kmer long, words long, before long, after long, doc_id long, version long, first int, n int"


def _neighbours(kmer: np.ndarray, doc: np.ndarray, step: int) -> pa.Array:
    """The k-mer of the path before (-1) or after (1) in the same text, else null."""
    other = np.roll(kmer, -step)
    gone = np.roll(doc, -step) != doc
    if len(gone):
        gone[-1 if step > 0 else 0] = True
    return pa.array(other.view(np.int64), mask=gone)


def _find_paths(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        h, offsets = _flat(batch.column("h"))
        h = h.view(np.uint64)
        for a, b in _parts(np.diff(offsets)):
            own = offsets[a : b + 1] - offsets[a]
            begin, n, kmer, whole = paths(h[offsets[a] : offsets[b]], own)
            doc = np.searchsorted(own, begin, "right") - 1
            rows = pa.array(doc + a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kmer.view(np.int64)), pa.array(whole.view(np.int64)), _neighbours(kmer, doc, -1), _neighbours(kmer, doc, 1),
                 batch.column("doc_id").take(rows), batch.column("version").take(rows),
                 pa.array((begin - own[doc]).astype(np.int32)), pa.array(n.astype(np.int32))],
                names=["kmer", "words", "before", "after", "doc_id", "version", "first", "n"],
            )
    _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    trim()


_PLACES = "kmer long, digest binary, doc_id long, version long, first int, n int"


def _read_source(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names the candidates of each text by their words: long edges whole, branching paths window by window."""
    for batch in it:
        firsts, at = _flat(batch.column("firsts"))
        sizes, kmers = _flat(batch.column("sizes"))[0], _flat(batch.column("kmers"))[0]
        branches = batch.column("branches").values.to_numpy(zero_copy_only=False)
        for i, text in enumerate(batch.column("text")):
            parts = text.as_py().split()  # bytes: splits at space and tab to carriage return
            source = memoryview(b" ".join(parts))
            ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
            f, n, k, b = (x[at[i] : at[i + 1]] for x in (firsts, sizes, kmers, branches))
            each = np.where(b, n, 1)
            first = np.repeat(f - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(each.sum()) if len(f) else f
            size = np.repeat(np.where(b, 1, n), each)
            lo, hi = ends[first] - np.fromiter((len(parts[x]) + 1 for x in first.tolist()), np.int64, len(first)), ends[first + size + WINDOW - 2] - 1
            digests = [hashlib.blake2b(source[x:y], digest_size=16).digest() for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
            one = pa.array(np.full(len(first), i))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(k, each)), pa.array(digests, pa.binary()), batch.column("doc_id").take(one), batch.column("version").take(one),
                 pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32))],
                names=["kmer", "digest", "doc_id", "version", "first", "n"],
            )
    trim()


@F.arrow_udf(T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]))
def _remove(text: pa.Array, firsts: pa.Array, sizes: pa.Array) -> pa.Array:
    """Words outside the windows that start in the runs (first, size), joined by one space."""
    removed, kept = [], []
    for t, f, n in zip(text, firsts, sizes, strict=True):
        parts = t.as_py().split()  # bytes: splits at space and tab to carriage return
        edge = np.zeros(len(parts) + 1, np.int64)
        a = f.values.to_numpy(zero_copy_only=False).astype(np.int64)
        np.add.at(edge, a, 1)
        np.add.at(edge, a + n.values.to_numpy(zero_copy_only=False) + WINDOW - 1, -1)
        stays = np.cumsum(edge[:-1]) == 0
        removed.append(int(len(parts) - stays.sum()))
        kept.append(b" ".join([p for p, s in zip(parts, stays.tolist(), strict=True) if s]).decode("utf-8", "replace"))
    out = pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["n_removed", "kept_text"])
    trim()
    return out


def _same_text(a: str, b: str):
    """A join condition on (doc_id, version); rows without id meet too."""
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.version") == F.col(f"{b}.version"))


class SubstringDedup:
    """One run over a table with doc_id and text."""

    def __init__(self, docs: DataFrame):
        self.docs, self.spark = docs, docs.sparkSession
        self.stage = Stage(self.spark, "substrings")
        # rows that share a doc_id are told apart by their texts
        version = F.xxhash64(F.coalesce("text", F.lit("")))
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), version.alias("version"), "text")

    def repeated_paths(self) -> DataFrame:
        """Paths of k-mers that occur twice or more; `branches` if not all of a k-mer are equal."""
        found = self.texts.select("doc_id", "version", hashes(words(F.col("text"))).alias("h")).mapInArrow(_find_paths, _PATHS)
        found = self.stage.write(found, "paths")
        count = found.groupBy("kmer").agg(F.count("*").alias("k"), F.min("words").alias("lo"), F.max("words").alias("hi"))
        twice = self.stage.write(count.filter("k > 1").select("kmer", (F.col("lo") != F.col("hi")).alias("branches")), "twice")
        out = self.stage.write(found.drop("words").join(twice, "kmer"), "repeated")
        self.stage.drop("paths", "twice")
        return out

    def chains(self, compact: DataFrame) -> DataFrame:
        """(kmer, chain, shift): the first compact edge of the chain that each is part of, and its distance in windows."""
        sole = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c)).alias(c)
        edges = self.stage.write(compact.groupBy("kmer").agg(sole("before"), sole("after"), F.min("n").alias("n")), "edges")
        ahead = edges.filter("after is not null").select(F.col("kmer").alias("before"), F.col("after").alias("kmer"), F.col("n").alias("shift"))
        linked = edges.select("kmer", "before").join(ahead, ["kmer", "before"], "left")
        at = self.stage.write(linked.select(
            "kmer", F.when(F.col("shift").isNull(), F.col("kmer")).otherwise(F.col("before")).alias("chain"), F.coalesce("shift", F.lit(0)).cast("long").alias("shift")
        ), "chain-0")
        left, k = at.filter("chain <> kmer").count(), 0
        while left:
            up = at.select(F.col("kmer").alias("chain"), F.col("chain").alias("further"), F.col("shift").alias("more"))
            k += 1
            at = self.stage.write(at.join(up, "chain").select("kmer", F.col("further").alias("chain"), (F.col("shift") + F.col("more")).alias("shift")), f"chain-{k}")
            heads = at.filter("chain = kmer").select(F.col("kmer").alias("chain"))
            now = at.join(heads, "chain", "left_anti").count()
            self.stage.drop(f"chain-{k - 1}")
            if now in (0, left):  # all have come to a first edge, or only circles are left
                break
            left = now
        if left and left == at.join(at.filter("chain = kmer").select(F.col("kmer").alias("chain")), "chain", "left_anti").count():
            # circles have no first edge: their edges stay as they are
            heads = at.filter("chain = kmer").select(F.col("kmer").alias("head"))
            known = at.join(heads, at["chain"] == heads["head"], "left")
            at = known.select("kmer", F.coalesce("head", "kmer").alias("chain"), F.when(F.col("head").isNotNull(), F.col("shift")).otherwise(0).alias("shift"))
        return at

    def candidates(self) -> DataFrame:
        """(doc_id, version, first, n, kmer, branches): long edges and branching paths in their documents."""
        repeated = self.repeated_paths()
        compact = repeated.filter("not branches").drop("branches")
        place = compact.join(self.chains(compact), "kmer").withColumn("start", F.col("first") - F.col("shift"))
        # all edges of a chain stand in a row wherever one of them does
        long = place.groupBy("doc_id", "version", "chain", "start").agg(F.min("first").alias("first"), F.max(F.col("first") + F.col("n")).alias("end"))
        long = long.select("doc_id", "version", "first", (F.col("end") - F.col("first")).cast("int").alias("n"), F.col("chain").alias("kmer"), F.lit(False).alias("branches"))
        branching = repeated.filter("branches").select("doc_id", "version", "first", "n", "kmer", "branches")
        return self.stage.write(long.unionByName(branching), "candidates")

    def thinned(self, ids: DataFrame) -> DataFrame:
        """Texts of the documents listed; texts of others aren't moved if the list is short."""
        ids = self.stage.write(ids, "ids")
        if ids.count() > ROWS_BROADCAST:
            return self.texts
        return self.texts.alias("t").join(F.broadcast(ids.alias("i")), _same_text("t", "i"), "left_semi")

    def repeated_places(self, candidates: DataFrame) -> DataFrame:
        """(doc_id, version, first, n) of the candidates whose words stand in two places or more."""
        item = F.struct("first", "n", "kmer", "branches")
        lists = candidates.groupBy("doc_id", "version").agg(F.collect_set(item).alias("s"))
        texts = self.thinned(candidates.select("doc_id", "version").distinct())
        both = texts.alias("t").join(lists.alias("l"), _same_text("t", "l")).select(
            "t.doc_id", "t.version", F.coalesce("t.text", F.lit("")).cast("binary").alias("text"),
            F.col("s.first").alias("firsts"), F.col("s.n").alias("sizes"), F.col("s.kmer").alias("kmers"), F.col("s.branches").alias("branches"),
        )
        places = self.stage.write(both.mapInArrow(_read_source, _PLACES), "places")
        release(self.spark)
        twice = places.groupBy("kmer", "digest").agg(F.count("*").alias("k")).filter("k > 1").select("kmer", "digest")
        twice = self.stage.write(twice, "twice")
        return places.join(twice, ["kmer", "digest"], "left_semi").select("doc_id", "version", "first", "n")

    def runs(self) -> DataFrame:
        """(doc_id, version, firsts, sizes): the runs of repeated windows of each document that has any."""
        lists = self.repeated_places(self.candidates()).groupBy("doc_id", "version").agg(F.collect_set(F.struct("first", "n")).alias("s"))
        out = self.stage.write(lists.select("doc_id", "version", F.col("s.first").alias("firsts"), F.col("s.n").alias("sizes")), "runs")
        self.stage.drop_others("runs")
        return out

    def run(self) -> DataFrame:
        """`doc`, all columns of the input, and `dedup`: n_words, n_removed and kept_text."""
        runs = self.runs()
        text = F.coalesce("doc.text", F.lit(""))
        docs = self.docs.select(F.struct("*").alias("doc")).withColumn("k", F.struct(F.col("doc.doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version")))
        same = lambda other: F.col("k.doc_id").eqNullSafe(F.col(f"{other}.doc_id")) & (F.col("k.version") == F.col(f"{other}.version"))
        ids = short(runs.select("doc_id", "version")).alias("i")
        # only texts that lose words are shuffled, if they are few
        rest, some = docs.join(ids, same("i"), "left_anti"), docs.join(ids, same("i"), "left_semi")
        joined = some.join(runs.alias("r"), same("r"))
        count = F.size(words(text)).cast("long")
        changed = joined.withColumn("cut", _remove(text.cast("binary"), F.col("r.firsts"), F.col("r.sizes")))
        changed = changed.select("doc", F.struct(count.alias("n_words"), "cut.n_removed", "cut.kept_text").alias("dedup"))
        whole = F.struct(count.alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join(words(text), " ").alias("kept_text"))
        return changed.unionByName(rest.select("doc", whole.alias("dedup")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All columns of docs, and the struct `dedup`."""
    rows = SubstringDedup(docs).run()
    return rows.select(*(F.col(f"doc.`{c}`") for c in docs.columns if c != "dedup"), "dedup")


def rewrite(docs: DataFrame) -> DataFrame:
    """docs with the repeated passages cut out of `text` and `n_chars` counted anew; texts that lose nothing stay as
    they are, and documents of which no word is left go."""
    rows = SubstringDedup(docs).run()
    cut = F.col("dedup.n_removed") > 0
    text = F.when(cut, F.col("dedup.kept_text")).otherwise(F.col("doc.text"))
    new = {"text": text, "n_chars": F.when(cut, F.length("dedup.kept_text").cast("long")).otherwise(F.col("doc.n_chars"))}
    row = F.struct(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
    left = ~cut | (F.col("dedup.n_words") > F.col("dedup.n_removed"))
    return rows.select(F.explode(F.when(left, F.array(row))).alias("d")).select("d.*")
