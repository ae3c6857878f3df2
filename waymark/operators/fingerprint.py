"""FNV-1a of texts that are too long for one row, as a composition of maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.ranking import placed

BASIS, PRIME, MASK = 0x811C9DC5, 16777619, 0xFFFFFFFF
#: Members of one chunk, and chunks that are composed at once.
MEMBERS, CHUNKS = 4096, 256


def chunk_map(text: bytes) -> tuple[int, np.ndarray]:
    """What hashing a chunk does to any state: a state of high part hi (without its last byte) and last byte lo becomes
    factor * hi + added[lo], modulo 2^32. A byte is xored into lo alone, so each byte's step is of this kind."""
    factor, added, lo = 1, np.arange(256, dtype=np.uint64), np.arange(256, dtype=np.uint64)
    for c in text:
        # hi * 256 + lo -> (hi * 256 + (lo ^ c)) * PRIME; what stands above lo keeps its factor
        added = ((added - lo + (lo ^ np.uint64(c))) * np.uint64(PRIME)) & np.uint64(MASK)
        lo, factor = added & np.uint64(255), factor * PRIME & MASK
    return factor, added


def compose(maps: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    """One map for several, the first of them applied first."""
    factor, added = 1, np.arange(256, dtype=np.uint64)
    for f, a in maps:
        lo = added & np.uint64(255)
        added, factor = ((added - lo) * np.uint64(f) + a[lo.astype(np.int64)]) & np.uint64(MASK), factor * f & MASK
    return factor, added


def _maps(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        made = [chunk_map(t.encode()) for t in b.column("text").to_pylist()]
        rest = [b.column("guide_id"), b.column("chunk"), pa.array([f for f, _ in made], pa.int64()), pa.array([a.astype(np.int64) for _, a in made], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(rest, names=["guide_id", "chunk", "factor", "added"])


def _composed(t: pa.Table) -> pa.Table:
    rows = sorted(t.to_pylist(), key=lambda r: r["chunk"])
    factor, added = compose([(r["factor"], np.array(r["added"], np.uint64)) for r in rows])
    return pa.table({
        "guide_id": [rows[0]["guide_id"]], "chunk": pa.array([rows[0]["chunk"] // CHUNKS], pa.int64()), "factor": pa.array([factor], pa.int64()), "added": pa.array([added.astype(np.int64)], pa.list_(pa.int64())),
    })


def long_fingerprints(listed: DataFrame) -> DataFrame:
    """(guide_id, n, hash) of the sorted members of each guide, joined by bars: members are placed over range partitions, chunks of MEMBERS are
    hashed to maps by many tasks, and CHUNKS maps of a guide at a time are composed until one is left."""
    inside = placed(listed.select("guide_id", "entity_id"), ["guide_id"], [F.asc("entity_id")])
    sized = inside.withColumn("chunk", F.floor((F.col("place") - 1) / MEMBERS))
    each = sized.groupBy("guide_id", "chunk").agg(F.array_sort(F.collect_list("entity_id")).alias("ids"), F.max("total").alias("total"))
    text = F.concat(F.when(F.col("chunk") > 0, "|").otherwise(""), F.array_join("ids", "|"))
    schema = "guide_id string, chunk long, factor long, added array<long>"
    maps = each.select("guide_id", "chunk", text.alias("text")).mapInArrow(_maps, schema)
    most = listed.groupBy("guide_id").count().agg(F.max("count")).first()[0] or 0
    left = -(-most // MEMBERS)
    while left > 1:
        maps, left = maps.groupBy("guide_id", F.floor(F.col("chunk") / CHUNKS).alias("group")).applyInArrow(_composed, schema), -(-left // CHUNKS)
    lo, high = BASIS & 255, BASIS - (BASIS & 255)
    hashed = (F.expr(f"(factor * {high >> 8}L) % {1 << 32}L") * 256 + F.get("added", F.lit(lo))) % (1 << 32)
    counts = listed.groupBy("guide_id").agg(F.count("*").alias("n"))
    return maps.select("guide_id", F.lpad(F.lower(F.hex(hashed.cast("long"))), 8, "0").alias("hash")).join(counts, "guide_id").select("guide_id", "n", "hash")
