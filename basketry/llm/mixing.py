"""Mixing sources to target weights by hierarchical budgeting, with DataFrame operations only.

The budget flows down a tree (domain, language, source). At every node the children share the
node's budget by weight; a child that cannot use its share (its documents, repeated at most
``max_epochs`` times, hold fewer tokens) is filled up and the rest goes to its siblings. A node's
capacity is the sum over its leaves, so a shortage leaves a node only when all its children are full:
siblings come before ancestors. Each leaf then takes whole epochs of its documents, and of
one more epoch the prefix, in that epoch's seeded order, that still fits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.session import materialize

UNKNOWN = "unknown"


def words(text: Column) -> Column:
    """Number of white-space separated words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \t\r\n\f\u000b]+")).cast("long")


def _weight(path: Sequence[Column], weights: Mapping[tuple[str, ...], float]) -> Column:
    out = F.lit(1.0)
    for key, w in weights.items():
        if len(key) == len(path):
            match = F.lit(True)
            for col, value in zip(path, key, strict=True):
                match = match & (F.lit(True) if value == "*" else col == value)
            out = F.when(match, F.lit(float(w))).otherwise(out)
    return out


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple[str, ...], float], total: float, max_epochs: int) -> DataFrame:
    """``leaves`` (levels..., tokens) with column ``quota``: the tokens that each leaf has to deliver."""
    level = leaves.withColumn("__capacity", F.col("tokens") * F.lit(max_epochs).cast("double"))
    room = leaves.agg(F.sum("tokens")).first()[0] or 0
    given = None
    for depth in range(1, len(levels) + 1):
        above = ["__root", *levels[: depth - 1]]
        node = level.withColumn("__root", F.lit(0)).groupBy(*above, levels[depth - 1]).agg(F.sum("__capacity").alias("__capacity"))
        node = node.withColumn("__w", F.greatest(_weight([F.col(c) for c in levels[:depth]], weights), F.lit(0.0)))
        node = node.withColumn("quota", F.lit(min(float(total), float(room * max_epochs)))) if given is None else node.join(given, above)
        node = node.withColumn("__ratio", F.when(F.col("__w") > 0, F.col("__capacity") / F.col("__w")).otherwise(F.lit(float("inf"))))
        order = Window.partitionBy(*above).orderBy("__ratio", levels[depth - 1])
        prior = order.rowsBetween(Window.unboundedPreceding, -1)
        rest = order.rowsBetween(0, Window.unboundedFollowing)
        node = node.withColumn("__before", F.coalesce(F.sum("__capacity").over(prior), F.lit(0.0))).withColumn("__left", F.sum("__w").over(rest))
        # a child is full if, at the price of its own filling, all cheaper ones full, the budget is not used up
        node = node.withColumn("__full", (F.col("__w") > 0) & (F.col("__ratio") * F.col("__left") + F.col("__before") <= F.col("quota") * (1 + 1e-12)))
        whole = Window.partitionBy(*above)
        free = F.greatest(F.col("quota") - F.sum(F.when(F.col("__full"), F.col("__capacity")).otherwise(0.0)).over(whole), F.lit(0.0))
        open_w = F.sum(F.when(F.col("__full"), 0.0).otherwise(F.col("__w"))).over(whole)
        share = F.when(F.col("__full"), F.col("__capacity")).when(open_w > 0, F.least(F.col("__capacity"), free * F.col("__w") / open_w)).otherwise(0.0)
        given = node.select("__root", *levels[:depth], share.alias("quota"))
    return leaves.join(given.drop("__root"), list(levels))


def _edge(sums: DataFrame, leaf: Sequence[str], at: str) -> DataFrame:
    """Per leaf the first of at most 256 values of ``at`` where the running sum passes __rest, and the sum before it as __base."""
    by = sums.groupBy(*leaf, at, "__rest", "__base").agg(F.sum("__sum").alias("__sum"))
    up_to = Window.partitionBy(*leaf).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    by = by.withColumn("__until", F.col("__base") + F.sum("__sum").over(up_to))
    crossed = by.where((F.col("__until") > F.col("__rest")) & (F.col("__until") - F.col("__sum") <= F.col("__rest")))
    return crossed.select(*leaf, at, (F.col("__until") - F.col("__sum")).alias("__base"))


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple[str, ...], float], share: float = 0.5,
        max_epochs: int = 4, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """One row per selected document and epoch: id, the levels, n_tokens, epoch (from 1); with_row: and the input row as struct ``row``.

    The budget is ``share`` of all tokens. A weight is found by its path ("*" matches any name; default 1);
    a null name is the group "unknown"; weight 0 gets nothing. Documents without words hold no tokens and
    are never selected. Documents are ordered within an epoch by a seeded hash of epoch and id, then id;
    rows with equal ids count together and are taken or left together (null ids too). The rest of a
    leaf that a whole document would exceed stays unused. An empty table gives an empty result.
    """
    names = list(levels)
    inner = [f"__{n}" for n in names]
    named = [F.coalesce(c.cast("string"), F.lit(UNKNOWN)).alias(f"__{n}") for n, c in levels.items()]
    count = words(F.col(f"`{text_col}`")).alias("__n")
    whole_row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if with_row else []
    slim = docs.select(F.col(f"`{id_col}`").alias("__id"), *named, count, *whole_row).where("__n > 0")
    light = materialize(slim.select("__id", *inner, "__n"))
    slim = slim if with_row else light
    leaves = materialize(light.groupBy(*inner).agg(F.sum("__n").alias("tokens")))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    quota = budgets(leaves, inner, weights, float(total) * share, max_epochs)
    quota = quota.withColumn("__whole", F.least(F.floor(F.col("quota") / F.col("tokens") + F.lit(1e-9)), F.lit(max_epochs)).cast("long"))
    quota = materialize(quota.select(*inner, "__whole", F.floor(F.col("quota") - F.col("__whole") * F.col("tokens") + F.lit(1e-6)).cast("long").alias("__rest")))
    # the seeded order of the epoch that is taken in part
    place = F.xxhash64(F.lit(seed), F.col("__whole") + 1, F.col("__id"))
    part = F.shiftrightunsigned(place, 48).cast("int")
    ordered = light.join(quota, inner).where("__rest > 0").select(*inner, "__rest", "__id", "__n", place.alias("__place"), part.alias("__range"))
    sums = ordered.groupBy(*inner, "__range", "__rest").agg(F.sum("__n").alias("__sum")).withColumn("__base", F.lit(0).cast("long"))
    # first among a leaf's 256 coarse ranges, then among the 256 fine ones of the coarse range that holds the edge
    coarse = _edge(sums.withColumn("__at", F.shiftright("__range", 8)), inner, "__at")
    fine = sums.drop("__base").withColumn("__at", F.shiftright("__range", 8)).join(coarse, [*inner, "__at"])
    edge = materialize(_edge(fine, inner, "__range"))
    in_edge = ordered.join(edge, [*inner, "__range"])
    # unsigned order within a range equals signed order, as its upper bits are equal
    running = Window.partitionBy(*inner).orderBy(F.struct("__place", "__id")).rangeBetween(Window.unboundedPreceding, 0)
    taken = in_edge.withColumn("__cum", F.col("__base") + F.sum("__n").over(running)).where("__cum <= __rest")
    cut = taken.groupBy(*inner).agg(F.max(F.struct("__place", "__id")).alias("__cut"))
    cuts = materialize(quota.join(edge, inner, "left").join(cut, inner, "left"))
    # without an edge the whole epoch fits; __rest is 0 there unless rounding hid a token
    before = (F.col("__range").isNull() & (F.col("__rest") > 0)) | (part < F.col("__range"))
    at_edge = (part == F.col("__range")) & F.col("__cut").isNotNull() & (F.struct(place.alias("__place"), F.col("__id").alias("__id")) <= F.col("__cut"))
    times = F.col("__whole") + F.when(F.coalesce(before | at_edge, F.lit(False)), 1).otherwise(0)
    chosen = slim.join(cuts, inner).withColumn("__times", times).where("__times > 0")
    epochs = chosen.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
    return epochs.select(F.col("__id").alias(id_col), *[F.col(i).alias(n) for i, n in zip(inner, names, strict=True)],
                         F.col("__n").alias("n_tokens"), F.col("epoch").cast("int").alias("epoch"), *(["row"] if with_row else []))
