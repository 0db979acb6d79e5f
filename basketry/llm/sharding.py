"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced jointly.

Groups of equal texts are the items. Groups that matter for the balance (at least 1/GRAIN of a
shard in some dimension, so their number is bounded whatever the input) are placed one by one;
all smaller groups are first bundled by hash into BUNDLES bundles of four falling sizes, which are
placed the same way. An item goes to the shard where the dot product of its vector with the
residual capacity is highest. The driver sees at most 3 * GRAIN * n_shards + 4 * BUNDLES * n_shards
items, never a table that grows with the input.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.session import materialize

#: A group is placed on its own from this share of a shard on.
GRAIN = 200
#: Bundles per shard in each of the four size classes, and the share of the small groups in each class.
BUNDLES = 40
CLASSES = (0.9, 0.09, 0.009, 0.001)
#: Slices by hashed id that carry the slot numbers.
SLICES = 4096
#: The weight of each dimension in the dot product: coarse items balance jointly, the last crumbs level the bytes.
COARSE, CRUMBS = (1.0, 0.25, 0.25), (1.0, 0.0, 0.0)


def place(items: np.ndarray, phase: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each item (rows of ``items``: bytes, tokens, rows), large items of early phases first."""
    total = np.maximum(items.sum(axis=0), 1.0)
    unit = items / total * n_shards
    residual = np.ones((n_shards, 3))
    shard = np.zeros(len(items), dtype=np.int64)
    for i in np.lexsort((np.arange(len(items)), -unit.max(axis=1), phase)):
        weights = np.array(CRUMBS if phase[i] >= 2 else COARSE)
        shard[i] = best = int(np.argmax(residual @ (weights * unit[i])))
        residual[best] -= unit[i]
    return shard


def shard(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law 'bytes', shard, slot, grown_shard (null).

    size is the UTF-8 bytes of the text plus 8. Equal texts share a shard, unless they outgrow one
    in bytes; such a group is split by hashed id into pieces of about half a shard. A null text has
    no bytes, size 8 and the checksum of the empty text, and counts as equal to other null texts.
    Repeated rows and null ids are ordinary rows and get slots of their own. An empty table gives
    an empty result. Other columns are ignored, whatever their names.
    """
    text = F.col(f"`{text_col}`").cast("string")
    filled = F.coalesce(text, F.lit(""))
    rows = materialize(docs.select(
        F.col(f"`{id_col}`").alias("__id"),
        (F.octet_length(filled) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.encode(filled, "UTF-8")).alias("text_crc32"),
        (F.length(filled) - F.length(F.replace(filled, F.lit(" "), F.lit(""))) + F.lit(1)).cast("long").alias("__tokens"),
        F.xxhash64(text).alias("__key"),
    ))
    sums = [F.sum("size").alias("b"), F.sum("__tokens").alias("t"), F.count(F.lit(1)).alias("r")]
    groups = materialize(rows.groupBy("__key").agg(*sums))
    total = groups.agg(F.sum("b"), F.sum("t"), F.sum("r")).first()
    cap = [max(1.0, float(x or 0) / n_shards) for x in total]
    big = " OR ".join(f"{c} >= {x / GRAIN!r}" for c, x in zip("btr", cap, strict=True))
    #: bounded: the groups of at least 1/GRAIN of a shard in one of three dimensions
    large = [(r["__key"], r["b"], r["t"], r["r"], max(1, -(-2 * r["b"] // int(cap[0]))) if r["b"] > cap[0] else 1) for r in groups.where(big).collect()]
    u = F.pmod(F.xxhash64("__key", F.lit(1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    bundle, low = F.lit(0), 0.0
    for k, share in enumerate(CLASSES):
        within = F.least(F.floor((u - F.lit(low)) / F.lit(share) * (BUNDLES * n_shards)), F.lit(BUNDLES * n_shards - 1))
        bundle = F.when(u >= low, within + F.lit(k * BUNDLES * n_shards)).otherwise(bundle)
        low += share
    bundle = bundle.cast("long")
    spark = docs.sparkSession
    bundled = groups.where(f"NOT ({big})").groupBy(bundle.alias("bundle")).agg(*[F.sum(c).alias(c) for c in "btr"]).collect()
    pieces = [(k, p) for k, *_, p in large if p > 1]  # at most n_shards groups outgrow a shard
    piece = F.lit(0).cast("long")
    for k, p in pieces:
        piece = F.when(F.col("__key") == F.lit(k), F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(p))).otherwise(piece)
    split = rows.where(F.col("__key").isin([k for k, _ in pieces])).groupBy("__key", piece.alias("p")).agg(*sums).collect() if pieces else []
    items = [(True, k, 0, b, t, r, 0) for k, b, t, r, p in large if p == 1]
    items += [(True, x["__key"], x["p"], x["b"], x["t"], x["r"], 0) for x in split]
    items += [(False, x["bundle"], 0, x["b"], x["t"], x["r"], x["bundle"] // (BUNDLES * n_shards)) for x in bundled]
    items.sort(key=lambda x: x[:3])
    at = place(np.array([x[3:6] for x in items], dtype=float).reshape(-1, 3), np.array([x[6] for x in items], dtype=np.int64), n_shards)
    # Both tables are broadcast; they hold the bounded items above.
    owner = F.broadcast(spark.createDataFrame(sorted({(x[1],) for x in items if x[0]}), "__key long").withColumn("__large", F.lit(True)))
    target = F.broadcast(spark.createDataFrame([(*x[:3], int(s)) for x, s in zip(items, at, strict=True)], "__large boolean, __item long, __piece long, shard int"))
    placed = rows.join(owner, "__key", "left").withColumn("__large", F.coalesce("__large", F.lit(False)))
    placed = placed.withColumn("__item", F.when(F.col("__large"), F.col("__key")).otherwise(bundle)).withColumn("__piece", F.when(F.col("__large"), piece).otherwise(F.lit(0).cast("long")))
    placed = placed.join(target, ["__large", "__item", "__piece"])
    placed = placed.select("__id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("__id", F.lit(3)), F.lit(SLICES)).alias("__slice"))
    placed = materialize(placed)
    counts = placed.groupBy("shard", "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(counts.select("shard", "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))  # n_shards * SLICES rows at most
    within = Window.partitionBy("shard", "__slice").orderBy("__id", "text_crc32")
    numbered = placed.withColumn("__in", F.row_number().over(within)).join(starts, ["shard", "__slice"])
    return numbered.select(
        F.col("__id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("__start") + F.col("__in") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
