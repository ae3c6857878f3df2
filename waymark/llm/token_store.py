"""A content-addressed store of token ids.

Each document's id stream is cut where a rolling hash of its last ids says so, so that equal passages give equal
chunks wherever they stand. A chunk's name is the SHA-256 of its bytes (little-endian 16-bit ids); unique chunks
are stored once, in Parquet. A document is a recipe, the list of its chunks' names; recipes are stored in
ascending order of doc_id with the number of ids before each. A Merkle manifest of SHA-256 over the recipes lets
a reader prove that nothing is missing or changed.

A task sends a chunk's bytes once, so a passage that a third of all documents share costs a row a task; recipes
are dealt by document. Nothing is gathered: prefix sums need one number for each partition, and a document's
checksum is combined from those of its chunks, so that reading back moves no ids either.

Defined results: a null text is empty and consists of the end id; a null doc_id comes first; repeated rows are
stored as documents of their own that share chunks, in any order among equals; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.pieces import Encoder, trim
from waymark.llm.staging import Stage, release

#: A cut where the top bits of the hash are zero: once in 512 ids, chunks of 64 to 4096.
CUT_BITS, LEAST, MOST = 9, 64, 4096
FANOUT = 1024
SENT_ONCE = 200_000

_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for all the tasks of a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Drops the worker's encoders; stages that don't encode needn't hold their memory."""
    _ENCODERS.clear()
    trim()


@lru_cache
def _gear() -> np.ndarray:
    """A random number for each id."""
    return np.random.default_rng(20240101).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)


def _rolled(h: np.ndarray) -> np.ndarray:
    """At each position the sum of the last 16 numbers, each shifted by its distance."""
    for step in (1, 2, 4, 8):
        moved = np.zeros_like(h)
        moved[step:] = h[:-step] << np.uint32(step) if len(h) > step else 0
        h = h + moved
    return h


def cut_points(n: int, cuts: list[int]) -> list[int]:
    """Ends of the chunks of a stream of n ids, given the places (after an id) where its hash asks for a cut."""
    out, at = [], 0
    for end in cuts:
        while end - at > MOST:
            at += MOST
            out.append(at)
        if end - at >= LEAST:
            out.append(end)
            at = end
    while n - at > MOST:
        at += MOST
        out.append(at)
    if at < n:
        out.append(n)
    return out


def wanted_cuts(streams: list[bytes]) -> list[list[int]]:
    """Where the hash asks for cuts in each stream of ids. The hash of a stream's first ids looks back at nothing:
    streams are kept apart by 16 blanks whose number is zero."""
    gap = bytes(2 * 16)
    ids = np.frombuffer(gap.join(streams), "<u2")
    ends = np.cumsum([len(s) // 2 + 16 for s in streams]) - 16
    numbers = _gear()[ids]
    for i in range(16):
        at = ends[:-1] + i
        numbers[at] = 0
    places = np.flatnonzero(_rolled(numbers) >> np.uint32(32 - CUT_BITS) == 0) + 1
    starts = np.concatenate(([0], ends[:-1] + 16))
    lo, hi = np.searchsorted(places, starts, "right"), np.searchsorted(places, ends, "right")
    return [(places[a:b] - s).tolist() for a, b, s in zip(lo.tolist(), hi.tolist(), starts.tolist(), strict=True)]


_CHUNKED = "kind string, digest binary, data binary, doc_id long, row long, names array<binary>, sizes array<int>"


def _chunk_documents(path: str, end_id: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(path).encode, np.array([end_id], "<u2").tobytes()
        sent: set[bytes] = set()
        for batch in it:
            chunks, names, sizes = {}, [], []
            streams = [raw + tail for raw in encode(batch.column("text").to_pylist())]
            for raw, cuts in zip(streams, wanted_cuts(streams) if streams else [], strict=True):
                own, at, lengths = [], 0, []
                for end in cut_points(len(raw) // 2, cuts):
                    part = raw[2 * at : 2 * end]
                    digest = hashlib.sha256(part).digest()
                    own.append(digest)
                    lengths.append(end - at)
                    if digest not in sent:
                        chunks[digest] = part
                        sent.add(digest)
                    at = end
                names.append(own)
                sizes.append(lengths)
            if len(sent) > SENT_ONCE:
                sent = set()
            n, m = len(chunks), len(names)
            null = lambda k, kind: pa.nulls(k, kind)
            lists, ints = pa.list_(pa.binary()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["chunk"] * n + ["recipe"] * m),
                    pa.array([*chunks, *([None] * m)], pa.binary()),
                    pa.array([*chunks.values(), *([None] * m)], pa.binary()),
                    pa.concat_arrays([null(n, pa.int64()), batch.column("doc_id")]),
                    pa.concat_arrays([null(n, pa.int64()), batch.column("row")]),
                    pa.array([*([None] * n), *names], lists),
                    pa.array([*([None] * n), *sizes], ints),
                ],
                names=["kind", "digest", "data", "doc_id", "row", "names", "sizes"],
            )

    return run


def _folded(names: str):
    """SHA-256 over an array of names, in order."""
    return F.unhex(F.sha2(F.unhex(F.array_join(F.transform(names, lambda d: F.hex(d)), "")), 256))


class Store:
    """Tables `chunks`, `recipes` and `manifest` below one shared folder."""

    def __init__(self, spark: SparkSession, stage: Stage):
        self.spark, self.stage = spark, stage

    def write(self, docs: DataFrame, path: str, end_id: int) -> None:
        rows = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text")
        )
        made = rows.mapInArrow(_chunk_documents(path, end_id), _CHUNKED)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # a recipe has a key of its own, so it passes
        dealt = made.withColumn("key", F.coalesce("digest", F.col("row").cast("string").cast("binary"))).repartition(n, "key")
        once = F.row_number().over(Window.partitionBy("key").orderBy("kind")) == 1
        both = self.stage.write(dealt.withColumn("once", once).filter("once").drop("key", "once"), "both", ["kind"])
        release(self.spark)
        self.chunks = both.filter("kind = 'chunk'").select("digest", "data")
        loose = both.filter("kind = 'recipe'").select("doc_id", "row", "names", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"))
        self._write_recipes(loose, n)

    def _write_recipes(self, loose: DataFrame, n: int) -> None:
        """Recipes in ascending order; each partition's total is one row."""
        placed = self.stage.write(loose.repartitionByRange(n, "doc_id", "row").withColumn("part", F.spark_partition_id()), "placed")
        totals = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        before = placed.groupBy("part").agg(F.sum("n_tokens").alias("t")).select("part", F.coalesce(F.sum("t").over(totals), F.lit(0)).alias("before"))
        order = Window.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"), "row")
        start = F.col("before") + F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
        # `before` has one row for each shuffle partition
        ordered = placed.join(F.broadcast(before), "part").select(
            "part", (F.row_number().over(order) - 1).alias("at"), "doc_id", "row", start.alias("start"), "n_tokens", "names", _folded("names").alias("root")
        )
        self.recipes = self.stage.write(ordered.sortWithinPartitions("part", "at"), "recipes")
        self.stage.drop("placed")
        self.manifest = self.stage.write(self._tree(self.recipes.select("part", "at", "root")), "manifest")

    @staticmethod
    def _tree(leaves: DataFrame) -> DataFrame:
        """Manifest nodes (level, part, at, root): documents by the thousand, those of a partition, then all."""
        fold = lambda df, *key: df.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("part", "at", "root"))).alias("s")).select(*key, _folded("s.root").alias("root"))
        low = fold(leaves.withColumn("block", F.floor(F.col("at") / FANOUT)), "part", "block").withColumnRenamed("block", "at")
        mid = fold(low, "part").withColumn("at", F.lit(0).cast("long"))
        top = fold(mid.withColumn("all", F.lit(0)), "all").select(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("at"), "root")
        level = lambda df, k: df.select(F.lit(k).alias("level"), "part", F.col("at").cast("long").alias("at"), "root")
        return level(low, 1).unionByName(level(mid, 2)).unionByName(level(top, 3))


#: The crc32 of n zero bytes, and the zero bytes of the longest chunk.
_ZEROS = bytes(4 * MOST)
_crc_of_zeros = lru_cache(MOST + 1)(lambda n: zlib.crc32(_ZEROS[:n]))


def combine_crc32(parts: list[tuple[int, int]]) -> int:
    """crc32 of a concatenation of chunks, from their crc32 and lengths in bytes: the checksum is affine, so the
    later part adds its own to that of the earlier one run on over zeros."""
    out = parts[0][0]
    for crc, n in parts[1:]:
        out = zlib.crc32(_ZEROS[:n], out) ^ crc ^ _crc_of_zeros(n)
    return out


def _check_chunks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Name, size and checksum of each stored chunk as it is read; a changed chunk is an error."""
    for batch in it:
        digests, sizes, crcs = batch.column("digest").to_pylist(), [], []
        for name, data in zip(digests, batch.column("data").to_pylist(), strict=True):
            if hashlib.sha256(data).digest() != name:
                raise ValueError(f"chunk {name.hex()} is damaged")
            ids = np.frombuffer(data, "<u2").astype("<u4")
            sizes.append(len(ids))
            crcs.append(zlib.crc32(ids.tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["digest", "n", "crc"])


def _combine_documents(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        tokens, crcs = [], []
        for parts in batch.column("parts").to_pylist():
            tokens.append(sum(p["n"] for p in parts))
            crcs.append(combine_crc32([(p["crc"], 4 * p["n"]) for p in parts]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(tokens, pa.int64()), pa.array(crcs, pa.int64())],
                                         names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(chunks: DataFrame, recipes: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of 32-bit ids) of every stored document. A recipe's missing chunk
    is an error; the roots are checked by verify_manifest."""
    facts = chunks.mapInArrow(_check_chunks, "digest binary, n long, crc long")
    wanted = recipes.select("doc_id", "row", "start", F.posexplode("names").alias("pos", "digest"))
    found = wanted.join(facts, "digest", "left")
    sure = F.coalesce("n", F.raise_error(F.concat(F.lit("chunk is missing: "), F.hex("digest"))).cast("long"))
    parts = F.sort_array(F.collect_list(F.struct("pos", sure.alias("n"), "crc"))).alias("parts")
    by_doc = found.groupBy("row", "doc_id", "start").agg(parts)
    return by_doc.select("doc_id", "start", "parts").mapInArrow(_combine_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def verify_manifest(store: Store) -> DataFrame:
    """Manifest nodes that the stored recipes don't reproduce; none if all is well."""
    recipes = store.recipes.select("part", "at", _folded("names").alias("root"))
    again = Store._tree(recipes).withColumnRenamed("root", "again")
    return store.manifest.join(again, ["level", "part", "at"], "full").filter(~F.col("root").eqNullSafe(F.col("again")))


def store_and_read(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Writes the store, then returns what is read from its files, once its recipes give the manifest's roots."""
    store = Store(docs.sparkSession, Stage(docs.sparkSession, "tokens"))
    store.write(docs, path, end_id)
    if bad := verify_manifest(store).select("level", "part", "at").head(5):
        raise ValueError(f"recipes don't give the manifest's roots, as at (level, part, at) {[tuple(r) for r in bad]}")
    return read_documents(store.chunks, store.recipes)
