"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Equal sets are one class first, so a group of exact copies is one node however large it is. Each class has TREES
labels of DEPTH minima; sorting by a label orders texts by longest common prefix, and the prefix tree over it is
walked from the leaves up in all trees: the least member of each node is a candidate for the least member of the node above.
How deep a region goes thus follows from how dense it is: texts that share long prefixes meet deep down, a lone pair at the
least depth, and a crowd of m near copies gives m candidates and not m * m. Nodes are aggregates, summed before the shuffle.

Candidates are confirmed on whole sets, and links so found are contracted to components. What a tree's representatives
can't show, links between other members of two components, is then found exactly among the texts that share a node of
any tree with another component: with shingles ordered by rarity, two sets that are similar enough share one of
their first few (prefix filter), and behind the first that they share both have enough left (positional filter), so
texts of different components that share such a shingle are candidates. Members of one component are never compared, as
rows of a shingle meet by pairs of components, which pass the same filters first; sketches of the signatures drop most of
the others before texts are read.

A link is lost only if its two texts meet in no tree at the least depth: at similarity 0.8 that is
(1 - 0.8^4)^24 = 3e-6 for each link without another path, or if the sketch is 6 standard deviations off. Lower similarities would
need other trees, so percent is 80 or more.

Defined results: a null or empty text has no shingles and is linked with nothing; a text of fewer words than a
shingle is one shingle; rows that share a doc_id are one node; a row without doc_id is kept and has no component;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.components import components
from waymark.llm.pieces import trim
from waymark.llm.staging import ROWS_BROADCAST, Stage, release, short, without
from waymark.llm.text import lower_ascii, words

TREES, DEPTH, LEAST_DEPTH, LEAST_PERCENT = 24, 8, 4, 80
#: Four bits of each of the 192 minima, sixteen to a long: texts of similarity 0.8 differ in 36 on average with a
#: deviation of 5.4, those of 0.63 in 69.
SKETCH_WORDS, SKETCH_DISTANCE, NIBBLES = 12, 69, 0x1111111111111111
BLOCK = 1 << 15


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(lower_ascii(w)))


def shingle_set(h: str, width: int) -> Column:
    """Distinct shingle hashes over a column of word hashes."""
    at = F.col(h)
    runs = F.transform(F.sequence(F.lit(0), F.size(at) - width), lambda i: F.xxhash64(*(F.get(at, i + k) for k in range(width))))
    whole = F.array(F.xxhash64(-F.size(at), *(F.get(at, F.lit(k)) for k in range(width - 1))))
    return F.when(F.size(at) >= width, F.array_distinct(runs)).when(F.size(at) > 0, whole).otherwise(F.array().cast("array<bigint>"))


@lru_cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240502)
    n = TREES * DEPTH
    return r.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


def signatures(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minima of every hash function (rows) over each non-empty set (columns)."""
    x = (flat >> np.uint64(32)).astype(np.uint32)
    a, b = _functions()
    out = np.empty((len(a), len(starts)), np.uint32)
    ends = np.append(starts[1:], len(x))
    lo = 0
    while lo < len(starts):  # blocks of sets that fit a processor's cache
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + BLOCK, "right")))
        part, at = x[starts[lo] : ends[hi - 1]], starts[lo:hi] - starts[lo]
        for j in range(len(a)):
            out[j, lo:hi] = np.minimum.reduceat(part * a[j] + b[j], at)
        lo = hi
    return out


def _labels(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each set its trees' keys at the least depth, the rest of their labels, and the sketch."""
    per_tree = sig.reshape(TREES, DEPTH, -1).astype(np.uint64)
    key = np.full((TREES, sig.shape[1]), 0x9E3779B97F4A7C15, np.uint64) * (np.arange(TREES, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1))
    for d in range(LEAST_DEPTH):
        key = (key ^ per_tree[:, d]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(33)
    rest = np.zeros_like(key)
    for d in range(LEAST_DEPTH, DEPTH):
        rest = rest << np.uint64(16) | (per_tree[:, d] & np.uint64(0xFFFF))
    parts = ((sig >> np.uint32(16)) & np.uint32(15)).reshape(SKETCH_WORDS, 16, -1)
    sketch = np.zeros((SKETCH_WORDS, sig.shape[1]), np.uint64)
    for i in range(16):
        sketch |= parts[:, i].astype(np.uint64) << np.uint64(4 * i)
    return key.T.view(np.int64), rest.T.view(np.int64), sketch.T.view(np.int64)


def _lists(a: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """Row i of a as the list of row rows[i]; the other lists are empty."""
    sizes = np.zeros(n + 1, np.int32)
    sizes[rows + 1] = a.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(np.ascontiguousarray(a).ravel()))


def _sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in it:
        sets = batch.column("s")
        offsets = sets.offsets.to_numpy()
        flat = sets.values.to_numpy(zero_copy_only=False).view(np.uint64)[offsets[0] : offsets[-1]]
        offsets = (offsets - offsets[0]).astype(np.int64)
        sizes = np.diff(offsets)
        some = np.flatnonzero(sizes)
        digests: list = [None] * len(sizes)
        for i in some.tolist():
            digests[i] = hashlib.blake2b(np.sort(flat[offsets[i] : offsets[i + 1]]).tobytes(), digest_size=16).digest()
        if len(some):
            key, rest, sketch = _labels(signatures(flat, offsets[some]))
        else:
            key, rest, sketch = (np.zeros((0, k), np.int64) for k in (TREES, TREES, SKETCH_WORDS))
        n = len(sizes)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes), pa.array(digests, pa.binary()), _lists(key, some, n), _lists(rest, some, n), _lists(sketch, some, n)],
            names=["doc_id", "n_shingles", "digest", "keys", "rests", "sketch"],
        )
    trim()


class NearDuplicates:
    """One run over a table of documents."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        if percent < LEAST_PERCENT:
            raise ValueError(f"trees are laid out for a similarity of {LEAST_PERCENT} % or more")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.width, self.percent = width, percent
        self.stage = Stage(docs.sparkSession, "near")

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """Members (doc_id, n_shingles, rep) and, for each class of equal sets, the signature of its least id."""
        hashed = self.docs.select("doc_id", word_hashes(F.col("text")).alias("h")).select("doc_id", shingle_set("h", self.width).alias("s"))
        signed = self.stage.write(
            hashed.mapInArrow(_sign, "doc_id long, n_shingles long, digest binary, keys array<long>, rests array<long>, sketch array<long>"), "signed"
        )
        least = signed.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
        # written, so that the join is one of two plain shuffles, which Spark can split
        joined = signed.join(self.stage.write(least, "least"), "digest", "left")
        members = self.stage.write(joined.select("doc_id", "n_shingles", "rep"), "members")
        reps = self.stage.write(joined.filter("doc_id = rep").select("rep", F.col("n_shingles").alias("n"), "keys", "rests", "sketch"), "reps")
        self.stage.drop("signed", "least")
        return members, reps

    def buckets(self, reps: DataFrame) -> DataFrame:
        """(key, rest, tree, rep) of the buckets at the least depth with two classes or more."""
        rows = reps.select("rep", F.posexplode(F.arrays_zip("keys", "rests")).alias("tree", "x")).select(
            F.col("x.keys").alias("key"), F.col("x.rests").alias("rest"), "tree", "rep"
        )
        shared = rows.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi").select("key")
        shared = self.stage.write(shared, "shared")
        return self.stage.write(rows.join(shared, "key", "left_semi"), "buckets")

    @staticmethod
    def tree_candidates(rows: DataFrame) -> DataFrame:
        """Pairs (a, b), a < b: along the prefix tree, the least member of a node and of the node above it."""
        cuts = [("key", F.col("key"))]
        for i, shift in enumerate((32, 0)):
            cuts.append((f"p{i}", F.shiftrightunsigned("rest", shift)))
        level = rows.select("rep", *(c.alias(n) for n, c in cuts))
        pairs, names = None, [n for n, _ in cuts]
        while names:
            least = level.groupBy(*names).agg(F.min("rep").alias("m"))
            up = level.join(least, names).filter("rep <> m").select(F.col("m").alias("a"), F.col("rep").alias("b"))
            pairs = up if pairs is None else pairs.union(up)
            level, names = least.withColumnRenamed("m", "rep"), names[:-1]
        return pairs.distinct()

    def confirm(self, pairs: DataFrame, tag: str) -> DataFrame:
        """Of distinct pairs those whose full sets are similar enough."""
        pairs = self.stage.write(pairs, f"{tag}-pairs")
        ids = self.stage.write(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), f"{tag}-ids")
        texts = self.docs.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= ROWS_BROADCAST else self.docs
        side = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"t{k}"))
        # one text a pair is shuffled: that of the member; its hub's comes once
        both = pairs.join(side("b"), "b").join(side("a"), "a")
        hashed = both.select("a", "b", word_hashes(F.col("ta")).alias("ha"), word_hashes(F.col("tb")).alias("hb"))
        sets = hashed.select("a", "b", shingle_set("ha", self.width).alias("sa"), shingle_set("hb", self.width).alias("sb"))
        sized = sets.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
        enough = 100 * F.col("common") >= self.percent * (F.col("na") + F.col("nb") - F.col("common"))
        # not a filter: Catalyst would push it below the columns of hashes and compute them anew for each element
        similar = sized.select(F.explode(F.when(enough, F.array(F.struct("a", "b")))).alias("p"))
        links = self.stage.write(similar.select("p.*").distinct(), f"{tag}-links")
        self.stage.drop(f"{tag}-pairs", f"{tag}-ids")
        return links

    def mixed(self, rows: DataFrame, reps: DataFrame, comp: DataFrame) -> DataFrame:
        """(rep, comp) of the classes that share a node of a tree with another component."""
        named = reps.select("rep").join(comp, reps["rep"] == comp["node"], "left").select("rep", F.coalesce("component", "rep").alias("comp"))
        named = self.stage.write(named, "named")
        known = rows.select("key", "rep").join(named, "rep")
        several = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
        several = self.stage.write(several, "several")
        return self.stage.write(known.join(several, "key", "left_semi").select("rep", "comp").distinct(), "mixed")

    def rare(self, mixed: DataFrame) -> DataFrame:
        """(g, rep, comp, n, rest): of each class the first few shingles by rarity, the size of its set, and how many of its
        shingles stand at g or behind. Shingles of one component only, which join nothing, are left out."""
        ids = short(mixed.select(F.col("rep").alias("doc_id")))
        hashed = self.docs.join(ids, "doc_id", "left_semi").select("doc_id", F.xxhash64("text").alias("v"), word_hashes(F.col("text")).alias("h"))
        each = hashed.select(F.col("doc_id").alias("rep"), "v", F.explode(shingle_set("h", self.width)).alias("g"))
        each = self.stage.write(each, "shingles")
        rarity = self.stage.write(each.groupBy("g").agg(F.count("*").alias("k")), "rarity")
        lists = each.join(rarity, "g").groupBy("rep", "v").agg(F.sort_array(F.collect_list(F.struct("k", "g"))).alias("s"))
        few = F.size("s") - F.expr(f"({self.percent} * size(s) + 99) div 100").cast("int") + 1
        first = F.transform(F.slice("s", F.lit(1), few), lambda x, i: F.struct(x["g"].alias("g"), F.size("s").alias("n"), (F.size("s") - i).alias("rest")))
        # rows that share a doc_id are one node with the shingles of all its texts
        probes = self.stage.write(lists.select("rep", F.inline(first)).join(mixed, "rep"), "probes")
        several = probes.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("g")
        out = self.stage.write(probes.join(self.stage.write(several, "several-g"), "g", "left_semi"), "rare")
        self.stage.drop("shingles", "rarity", "probes", "several-g")
        return out

    @staticmethod
    def _distance() -> Column:
        """Minima in which the sketches of a pair differ."""
        out = F.lit(0)
        for i in range(SKETCH_WORDS):
            x = F.get("sketch", F.lit(i)).bitwiseXOR(F.get("sketch2", F.lit(i)))
            for n in (1, 2):
                x = x.bitwiseOR(F.shiftrightunsigned(x, n))
            out = out + F.bit_count(x.bitwiseAND(F.lit(NIBBLES)))
        return out

    def across(self, rare: DataFrame, reps: DataFrame) -> DataFrame:
        """Pairs of different components that share a rare shingle, whose sizes and places of it allow the similarity, and whose
        sketches do."""
        p = self.percent
        enough = lambda n, rest, m, left: (100 + p) * F.least(rest, left) >= p * (n + m)
        second = lambda df: df.select("g", *(F.col(c).alias(f"{c}2") for c in df.columns if c != "g"))
        # pairs of components first: members of one component, however many, never meet
        each = rare.groupBy("g", "comp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"))
        each = self.stage.write(each, "each")
        fits = (100 * F.col("high") >= p * F.col("low2")) & (100 * F.col("high2") >= p * F.col("low")) & enough(F.col("low"), F.col("rest"), F.col("low2"), F.col("rest2"))
        kinds = each.join(second(each), "g").filter((F.col("comp2") < F.col("comp")) & fits).select("g", "comp", "comp2")
        kinds = self.stage.write(kinds, "kinds")
        here = self.stage.write(rare.join(reps.select("rep", "sketch"), "rep"), "here")
        alike = (100 * F.least("n", "n2") >= p * F.greatest("n", "n2")) & enough(F.col("n"), F.col("rest"), F.col("n2"), F.col("rest2"))
        left = self.stage.write(here.join(kinds, ["g", "comp"]), "left")
        met = left.join(second(here), ["g", "comp2"]).filter(alike & (self._distance() <= SKETCH_DISTANCE))
        return met.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()

    def run(self) -> DataFrame:
        members, reps = self.classes()
        rows = self.buckets(reps)
        links = self.confirm(self.tree_candidates(rows), "tree")
        comp = components(links, self.stage, "c1")
        found = self.confirm(self.across(self.rare(self.mixed(rows, reps, comp)), reps), "across")
        old = comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
        named = self.stage.write(components(old.union(found), self.stage, "c2"), "component")
        self.stage.drop_others("members", "component")
        joined = members.join(named, members["rep"] == named["node"], "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
        return joined.select(
            "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
        )


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return NearDuplicates(docs, width, percent).run()


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns."""
    stage = Stage(docs.sparkSession, "near-kept")
    judged = stage.write(near_duplicates(docs, width, percent).select("doc_id", "kept"), "judged")
    gone = judged.filter("not kept").select("doc_id").distinct()
    out = without(docs, gone, F.col("doc.doc_id").cast("long") == F.col("listed.doc_id"), stage)
    repeated = judged.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        return out
    # rows that share a doc_id are one node, of which one stays; rows without are kept
    return out.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(out.filter("doc_id is null"))
