"""Shards of near-equal bytes by sampled splitters.

Rows are ordered by group (a digest of the text), doc_id and row. A size-weighted Poisson sample of the keys gives quantile
boundaries, and every row is put into the range between two of them by a binary search. Ranges are then weighed exactly; those
that hold over twice their share, be it by chance or because one group holds a third of all rows, are subdivided
at boundaries from a denser sample of their own until none is left. Ranges only bound the work of a task: running sums inside them and the exact
sizes of the ranges before give each row its place in the whole order, and shards are cut there at equal bytes, so the
result doesn't depend on the sample.

Rows of one group stand next to each other. A group of at most 1/200 of a shard (and 1/16 of a range) goes whole where its middle
falls; a larger one is cut where a shard ends. A shard thus misses its share by one such group or one row.

The driver holds RANGES splitters, twice as many after subdivision, and SAMPLES keys for each: 2^17 and 2^19 rows of
four numbers at any size of the input.

Defined results: a null text is an empty one; rows without doc_id come first in their group; equal rows are rows of their own
with a slot each; a row larger than a shard fills its shard alone or nearly so, and shards around it may be empty; an empty
table gives an empty result; other columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.staging import Stage

RANGES, RANGE_BYTES, SAMPLES = 1 << 16, 32 << 20, 8
#: A group is kept whole up to this part of a shard, and of a range.
OF_SHARD, OF_RANGE = 200, 16
FILE_BYTES = 256 << 20
LEAST = np.iinfo(np.int64).min
KEYS = ["g", "k", "r"]


def text_size(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 8


def text_group(text: Column) -> Column:
    """The first 60 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def ranks(keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For each key (columns of a matrix, compared row by row) the number of cuts at or below it."""
    both = np.concatenate((cuts, keys), axis=1)
    is_key = np.arange(both.shape[1]) >= cuts.shape[1]
    order = np.lexsort((is_key, *both[::-1]))
    out = np.empty(both.shape[1], np.int64)
    out[order] = np.cumsum(~is_key[order])
    return out[cuts.shape[1] :]


def boundaries(sample: np.ndarray, weights: np.ndarray, target: float) -> np.ndarray:
    """Keys at which a new range begins, so that each holds about target by the sample. The first boundary within a group
    is the group's start, so that only groups with two boundaries are cut."""
    order, out, held, group = np.lexsort(sample[::-1]), [], 0.0, None
    for i in order.tolist():
        if held and held + weights[i] > target:
            out.append([sample[0, i], LEAST, LEAST] if sample[0, i] != group else sample[:, i].tolist())
            held, group = 0.0, sample[0, i]
        held += weights[i]
    return np.array(out, np.int64).reshape(-1, len(KEYS)).T


class Sharding:
    """One run over a table of rows: docs is kept as a struct beside its size and its key."""

    def __init__(self, docs: DataFrame, size: Column, group: Column, order: Column, shards: int):
        self.stage, self.shards = Stage(docs.sparkSession, "shards"), shards
        least = F.lit(int(LEAST))
        keyed = docs.select(
            F.struct("*").alias("doc"), size.alias("size"), group.alias("g"), F.coalesce(order.cast("long"), least).alias("k"), F.monotonically_increasing_id().alias("r")
        )
        self.rows = self.stage.write(keyed, "rows")  # written, so that r names a row from here on
        self.keys = self.rows.select("size", *KEYS)
        got = self.keys.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
        self.total, self.n = got["bytes"] or 0, got["n"]
        self.ranges = min(RANGES, max(4 * shards, self.total // RANGE_BYTES))
        self.target = max(1, self.total // self.ranges)

    def sample(self, keys: DataFrame, per_range: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys drawn in proportion to their size, per_range of them for each target of bytes, and what each stands for."""
        step = max(1, self.target // per_range)
        draw = F.pmod(F.xxhash64(*KEYS, F.lit(salt)), F.lit(step))
        got = keys.filter(draw < F.col("size")).select(*KEYS, "size").toPandas()
        return got[KEYS].to_numpy(np.int64).T, np.maximum(got["size"].to_numpy(np.float64), step)

    @staticmethod
    def ranged(rows: DataFrame, cuts: np.ndarray, before: np.ndarray | None = None) -> DataFrame:
        """rows with the range they fall into and, if they are known, the bytes and rows of the ranges before it."""
        names = ["range", "bytes_before", "rows_before"] if before is not None else ["range"]

        def locate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                at = ranks(np.stack([b.column(k).to_numpy() for k in KEYS]), cuts)
                more = [at] if before is None else [at, before[0][at], before[1][at]]
                yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, more)], names=[*b.schema.names, *names])

        return rows.mapInArrow(locate, T.StructType([*rows.schema, *(T.StructField(name, T.LongType()) for name in names)]))

    def weigh(self, cuts: np.ndarray) -> np.ndarray:
        """Bytes, rows and largest row of each range."""
        sums = self.ranged(self.keys, cuts).groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("size").alias("m")).toPandas()
        out = np.zeros((3, cuts.shape[1] + 1), np.int64)
        for i, c in enumerate("bnm"):
            out[i, sums["range"].to_numpy(np.int64)] = sums[c]
        return out

    def splitters(self) -> tuple[np.ndarray, np.ndarray]:
        """Boundaries between ranges none of which is overfull, and the ranges' weights."""
        per_range, salt = SAMPLES, 0
        cuts = boundaries(*self.sample(self.keys, per_range, salt), self.target)
        while True:
            weights = self.weigh(cuts)
            over = np.flatnonzero(weights[0] - weights[2] > 2 * self.target)
            if not len(over):
                return cuts, weights
            per_range, salt = 4 * per_range, salt + 1
            inside = self.ranged(self.keys, cuts).filter(F.array_contains(F.lit(over.tolist()), F.col("range")))
            more = [cuts]
            sample, stand = self.sample(inside, per_range, salt)
            at = ranks(sample, cuts)
            for r in over.tolist():
                more.append(boundaries(sample[:, at == r], stand[at == r], self.target))
            cuts = np.unique(np.concatenate(more, axis=1), axis=1)  # in lexicographic order

    def run(self) -> DataFrame:
        """doc, size, shard, slot and file, a number within the shard that rises every FILE_BYTES."""
        cuts, weights = self.splitters()
        before = np.concatenate((np.zeros((2, 1), np.int64), np.cumsum(weights[:2], axis=1)), axis=1)
        inside, group = Window.partitionBy("range").orderBy(*KEYS), Window.partitionBy("range", "g")
        upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = (
            self.ranged(self.rows, cuts, before)
            .withColumns({"at": F.col("rows_before") + F.row_number().over(inside) - 1, "start": F.col("bytes_before") + F.sum("size").over(upto) - F.col("size")})
            .withColumns({"group_size": F.sum("size").over(group), "group_start": F.min("start").over(group)})
        )
        whole = min(self.total // (OF_SHARD * self.shards), self.target // OF_RANGE)
        middle = F.when(F.col("group_size") <= whole, 2 * F.col("group_start") + F.col("group_size")).otherwise(2 * F.col("start") + F.col("size"))
        shard = F.least(F.lit(self.shards - 1), F.floor(middle.cast("decimal(38,0)") * self.shards / (2 * max(1, self.total)))).cast("int")
        placed = self.stage.write(placed.select("doc", "size", "at", "start", shard.alias("shard")), "placed")
        first = placed.groupBy("shard").agg(F.min("at").alias("first"), F.min("start").alias("first_start"))
        out = placed.join(F.broadcast(first), "shard")  # a row for each shard
        self.stage.drop("rows")
        file = ((F.col("start") - F.col("first_start")) / FILE_BYTES).cast("int")
        return out.select("doc", "size", "shard", (F.col("at") - F.col("first")).alias("slot"), file.alias("file"))


def assign(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc, size, shard, slot, file) for every row of docs, kept in the struct doc."""
    text = F.col("text")
    return Sharding(docs, text_size(text), text_group(text), F.col("doc_id"), shards).run()


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """The rows of docs as Parquet folders shard=0, 1, ..., files bounded in bytes and in slot order."""
    out = assign(docs, shards).repartition("shard", "file").sortWithinPartitions("shard", "slot")
    names = [c for c in docs.columns if c.lower() != "shard"]  # the folder's name holds the new one
    out.select(*(F.col("doc")[c].alias(c) for c in names), "shard").write.partitionBy("shard").parquet(path)


def digests(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, CRC-32 of the text, law, shard and slot; texts are weighed and digested where they are read, so that only
    numbers move."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", text_size(text).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_group(text).alias("g"))
    out = Sharding(narrow, F.col("size"), F.col("g"), F.col("doc_id"), shards).run()
    return out.select("doc.doc_id", "size", "doc.text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
