"""Density-based clustering (C8, J7, X1): DBSCAN with ``eps`` and ``min_pts`` (self included), any number of columns.

Exact. Neighbourhoods are resolved on bounding boxes, halved level by level, and only boxes that are neither
wholly inside nor wholly outside ``eps`` of each other go one level down:

1. identical points collapse into one weighted point (a group of copies is one row);
2. points fall into micro-cells of side ``eps / sqrt(d)``: any two points of a cell are within ``eps``, so a cell
   of weight >= ``min_pts`` is all core without looking at a single pair;
3. near cells are found by a dual descent of one box tree: from a single root, pairs of boxes are replaced by pairs of their
   children, SPLITS halvings at a time, and dropped where they are more than ``eps`` apart. No offset is
   enumerated, so the work follows the boxes that hold points, whatever the number of columns;
4. the degree of points in sparse cells: weights of boxes wholly within ``eps`` add up, straddling boxes are halved. A
   point stops as soon as it has ``min_pts``, or can't reach it with all that still straddles;
5. core points of one cell are one node. Cells are linked where boxes or two points of each prove it; pairs of cells of one
   component are dropped, and what still straddles between different components is halved, LEVELS times at most, then compared
   point by point;
6. a border point joins the lowest-labelled cluster with a core point within ``eps`` (scikit-learn picks by visiting
   order, so only border labels can differ; cluster count and noise do not). Boxes of higher labels than the
   best one found are dropped.

Each level is a written table in the shared checkpoint folder, so the lineage stays one level long. Labels are component
ids (the smallest cell number of the cluster), -1 for noise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.session import ensure_checkpoint_dir, materialize

#: Halvings between two levels of the tree over the cells, and levels of halved boxes within cells.
SPLITS, LEVELS = 6, 4


def _sq(terms) -> Column:
    return sum((t * t for t in terms), F.lit(0.0))


def _point_box(d: int):
    """Squared least and greatest distance from the point ``x{i}`` to the box ``lo{i}``/``hi{i}``."""
    gaps = [F.greatest(F.col(f"lo{i}") - F.col(f"x{i}"), F.col(f"x{i}") - F.col(f"hi{i}"), F.lit(0.0)) for i in range(d)]
    fars = [F.greatest(F.abs(F.col(f"x{i}") - F.col(f"lo{i}")), F.abs(F.col(f"x{i}") - F.col(f"hi{i}"))) for i in range(d)]
    return _sq(gaps), _sq(fars)


def _box_box(d: int):
    """The same between the boxes ``alo{i}``/``ahi{i}`` and ``blo{i}``/``bhi{i}``."""
    gaps = [F.greatest(F.col(f"blo{i}") - F.col(f"ahi{i}"), F.col(f"alo{i}") - F.col(f"bhi{i}"), F.lit(0.0)) for i in range(d)]
    spans = [F.greatest(F.col(f"bhi{i}") - F.col(f"alo{i}"), F.col(f"ahi{i}") - F.col(f"blo{i}")) for i in range(d)]
    return _sq(gaps), _sq(spans)


def _sided(boxes: DataFrame, side: str, d: int) -> DataFrame:
    """(``side``, c``side``, bounds): the boxes as children of one side of a pair."""
    bounds = [F.col(f"{e}{i}").alias(f"{side}{e}{i}") for e in ("lo", "hi") for i in range(d)]
    return boxes.select(F.col("parent").alias(side), F.col("box").alias(f"c{side}"), *bounds)


class _Boxes:
    """The boxes of halved cells of a table of points (cell, w, x0 ..): level 0 are the cells themselves."""

    def __init__(self, points: DataFrame, d: int, origin: Sequence[float], side: float) -> None:
        self.points, self.d, self.origin, self.side = points, d, origin, side

    def ident(self, level: int) -> Column:
        if level == 0:
            return F.col("cell")
        halves = [F.floor((F.col(f"x{i}") - F.lit(o)) * (2**level / self.side)) for i, o in enumerate(self.origin)]
        return F.xxhash64("cell", F.lit(level), *halves)

    def at(self, level: int) -> DataFrame:
        """(parent, box, w, bounds); the parent of a cell is itself. Two boxes that share a hash would be one larger box, which is as right."""
        ends = [f(f"x{i}").alias(f"{e}{i}") for e, f in (("lo", F.min), ("hi", F.max)) for i in range(self.d)]
        return self.points.groupBy(self.ident(max(0, level - 1)).alias("parent"), self.ident(level).alias("box")).agg(F.sum("w").alias("w"), *ends)

    def members(self, level: int) -> DataFrame:
        """(box, w, y0 ..): the points of the boxes of a level."""
        return self.points.select(self.ident(level).alias("box"), "w", *[F.col(f"x{i}").alias(f"y{i}") for i in range(self.d)])


def _near_cells(cells: DataFrame, d: int, eps2: float) -> DataFrame:
    """(a, b): the pairs a < b of cells (cell, c0 .., lo0 .., hi0 ..) whose boxes are within eps, by a dual descent of the tree."""
    top = max((int(v) for v in cells.agg(*[F.max(f"c{i}") for i in range(d)]).first() if v is not None), default=0)
    bits = max(1, top.bit_length())

    def ident(taken: int) -> Column:
        """The box of a cell after ``taken`` halvings of the root, one column after the other."""
        if taken >= bits * d:
            return F.col("cell")
        own = [taken // d + (i < taken % d) for i in range(d)]
        return F.xxhash64(F.lit(taken), *[F.shiftright(f"c{i}", bits - n) for i, n in enumerate(own)])

    pairs = cells.select(ident(0).alias("a")).distinct().withColumn("b", F.col("a"))
    for taken in range(0, bits * d, SPLITS):
        ends = [f(f"{e}{i}").alias(f"{e}{i}") for e, f in (("lo", F.min), ("hi", F.max)) for i in range(d)]
        children = cells.groupBy(ident(taken).alias("parent"), ident(taken + SPLITS).alias("box")).agg(*ends)
        both = pairs.join(_sided(children, "a", d), "a").join(_sided(children, "b", d), "b")
        least, _ = _box_box(d)
        both = both.where(((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb"))) & (least <= eps2))
        pairs = materialize(both.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    return pairs.where("a <> b")


def connected_components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Smallest node id per connected component, by min-label propagation with pointer jumping.

    ``edges`` (a, b) holds both directions; ``labels`` (node, label) starts with label = node.
    Each round takes the smallest label among a node's neighbours, then jumps to the label of
    that label (both are nodes of the same component), which shortens long chains geometrically.
    Every round is a written table, so the lineage stays one round long.
    """
    while True:  # labels only fall, so this ends
        best = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("nl"))
        step = labels.join(best.withColumnRenamed("a", "node"), "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("nl", "label")).alias("l1"))
        hop = step.select(F.col("node").alias("l1"), F.col("l1").alias("l2"))
        new = materialize(
            step.join(hop, "l1", "left")
            .select("node", "old", F.least("l1", F.coalesce("l2", "l1")).alias("label"))
        )
        changed = new.where(F.col("label") != F.col("old")).limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def _cores(points: DataFrame, around: DataFrame, boxes: _Boxes, eps2: float, min_pts: int) -> DataFrame:
    """(pid): the points of sparse cells that have min_pts within eps. ``around`` (cell, other) has both directions."""
    d = boxes.d
    X = [f"x{i}" for i in range(d)]
    sparse = points.where(F.col("cw") < min_pts)
    known = sparse.select("pid", F.col("cw").alias("sure"))
    least, most = _point_box(d)
    open_ = sparse.select("pid", *X, "cell").join(around, "cell").select("pid", *X, F.col("other").alias("parent"))
    found = None
    for level in range(LEVELS + 2):
        if level <= LEVELS:
            met = open_.join(boxes.at(level), "parent").select("pid", *X, "box", "w", least.alias("least"), most.alias("most"))
        else:
            met = open_.withColumnRenamed("parent", "box").join(boxes.members(LEVELS), "box")
            met = met.withColumn("least", _sq([F.col(x) - F.col(f"y{i}") for i, x in enumerate(X)])).select("pid", *X, "box", "w", "least", F.col("least").alias("most"))
        met = materialize(met.where(F.col("least") <= eps2).select("pid", *X, "box", "w", (F.col("most") <= eps2).alias("full")))
        sums = met.groupBy("pid").agg(F.sum(F.when(F.col("full"), F.col("w"))).alias("s"), F.sum(F.when(~F.col("full"), F.col("w"))).alias("m"))
        known = known.join(sums, "pid", "left").select("pid", (F.col("sure") + F.coalesce("s", F.lit(0))).alias("sure"), F.coalesce("m", F.lit(0)).alias("maybe"))
        known = materialize(known.where(F.col("sure") + F.col("maybe") >= min_pts))
        core = known.where(F.col("sure") >= min_pts).select("pid")
        found = core if found is None else found.unionByName(core)
        known = known.where(F.col("sure") < min_pts).select("pid", "sure")
        if not known.take(1):
            break
        open_ = met.where(~F.col("full")).join(known.select("pid"), "pid", "left_semi").select("pid", *X, F.col("box").alias("parent"))
    return found


def _both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.col(a).alias("a"), F.col(b).alias("b")).unionByName(edges.select(F.col(b).alias("a"), F.col(a).alias("b"))).distinct()


def _linked(near: DataFrame, boxes: _Boxes, eps2: float) -> DataFrame:
    """(node, label): the component of each cell with core points, whose boxes are ``boxes``."""
    d = boxes.d
    least, most = _box_box(d)
    cells = boxes.at(0)
    X = F.struct(*[f"x{i}" for i in range(d)])
    # two points of each cell, its first and last by value: where a pair of them is within eps, the cells are linked
    ends = boxes.points.groupBy("cell").agg(F.min(X).alias("p"), F.max(X).alias("q"))
    met = near.join(_sided(cells, "a", d), "a").join(_sided(cells, "b", d), "b").where(least <= eps2)
    for side in "ab":
        met = met.join(ends.select(F.col("cell").alias(side), F.col("p").alias(f"{side}p"), F.col("q").alias(f"{side}q")), side)
    apart = [_sq([F.col(f"a{u}.x{i}") - F.col(f"b{v}.x{i}") for i in range(d)]) for u in "pq" for v in "pq"]
    met = materialize(met.select("a", "b", ((most <= eps2) | (F.least(*apart) <= eps2)).alias("full")))
    nodes = cells.select(F.col("box").alias("node")).withColumn("label", F.col("node"))
    labels = connected_components(materialize(_both_ways(met.where("full"), "a", "b")), materialize(nodes))
    open_ = met.where("NOT full").join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
    open_ = materialize(open_.join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("la <> lb").select("a", "b", "la", "lb"))
    for level in range(1, LEVELS + 2):
        if not open_.take(1):
            break
        if level <= LEVELS:
            half = boxes.at(level)
            met = open_.join(_sided(half, "a", d), "a").join(_sided(half, "b", d), "b").where(least <= eps2)
            met = met.select("la", "lb", F.col("ca").alias("a"), F.col("cb").alias("b"), (most <= eps2).alias("full"))
        else:
            own = boxes.members(LEVELS).drop("w")
            left = own.select(F.col("box").alias("a"), *[F.col(f"y{i}").alias(f"x{i}") for i in range(d)])
            met = open_.join(left, "a").join(own.withColumnRenamed("box", "b"), "b")
            met = met.where(_sq([F.col(f"x{i}") - F.col(f"y{i}") for i in range(d)]) <= eps2).select("la", "lb", "a", "b", F.lit(True).alias("full"))
        met = materialize(met)
        edges = materialize(_both_ways(met.where("full"), "la", "lb"))
        if edges.take(1):
            ends = materialize(edges.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
            merged = connected_components(edges, ends)
            renamed = lambda df, c: df.join(merged.select(F.col("node").alias(c), F.col("label").alias("__to")), c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")  # noqa: B023, E731
            labels = materialize(renamed(labels, "label"))
            met = renamed(renamed(met, "la"), "lb")
        open_ = materialize(met.where("NOT full AND la <> lb").select("a", "b", "la", "lb"))
    return labels


def _border(points: DataFrame, around: DataFrame, boxes: _Boxes, labels: DataFrame, eps2: float) -> DataFrame:
    """(pid, label): the least label with a core point within eps, for points that are none."""
    d = boxes.d
    X = [f"x{i}" for i in range(d)]
    named = labels.select(F.col("node").alias("parent"), "label")
    least, most = _point_box(d)
    best = materialize(points.select("pid", F.col("cell").alias("parent")).join(named, "parent").select("pid", "label"))
    open_ = points.select("pid", *X, "cell").join(around, "cell").select("pid", *X, F.col("other").alias("parent")).join(named, "parent")
    for level in range(LEVELS + 2):
        worth = open_.join(best.withColumnRenamed("label", "best"), "pid", "left").where("best IS NULL OR label < best").drop("best")
        if level <= LEVELS:
            met = worth.join(boxes.at(level), "parent").select("pid", *X, "label", "box", least.alias("least"), most.alias("most"))
        else:
            met = worth.withColumnRenamed("parent", "box").join(boxes.members(LEVELS), "box")
            met = met.withColumn("least", _sq([F.col(x) - F.col(f"y{i}") for i, x in enumerate(X)])).select("pid", *X, "label", "box", "least", F.col("least").alias("most"))
        met = materialize(met.where(F.col("least") <= eps2).select("pid", *X, "label", "box", (F.col("most") <= eps2).alias("full")))
        best = materialize(best.unionByName(met.where("full").select("pid", "label")).groupBy("pid").agg(F.min("label").alias("label")))
        open_ = met.where("NOT full").select("pid", *X, "label", F.col("box").alias("parent"))
        if not open_.take(1):
            break
    return best


def dbscan(points: DataFrame, cols: Sequence[str], id_col: str, eps: float = 0.5, min_pts: int = 5) -> DataFrame:
    """Per input row with a value in every column: ``id``, ``label`` (-1 = noise) and ``is_core``."""
    if not cols:
        raise ValueError("dbscan needs a column at least")
    spark = points.sparkSession
    ensure_checkpoint_dir(spark)
    d = len(cols)
    eps2 = eps * eps
    side = eps / math.sqrt(d) * (1 - 1e-6)
    X = [f"x{i}" for i in range(d)]
    C = [f"c{i}" for i in range(d)]
    raw = points.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(x) for c, x in zip(cols, X, strict=True)]).na.drop(subset=X)
    # the point id is assigned before the single write, so it is fixed and unique even when the input ids are not
    pts = materialize(raw.groupBy(*X).agg(F.count(F.lit(1)).alias("w")).select(F.monotonically_increasing_id().alias("pid"), "w", *X))
    members = raw.join(pts.select("pid", *X), X).select("id", "pid")
    origin = [float(v or 0.0) for v in pts.agg(*[F.min(x) for x in X]).first()]
    celled = pts.select("*", *[F.floor((F.col(x) - F.lit(o)) / side).alias(c) for x, c, o in zip(X, C, origin, strict=True)])
    ends = [f(x).alias(f"{e}{i}") for e, f in (("lo", F.min), ("hi", F.max)) for i, x in enumerate(X)]
    cells = materialize(celled.groupBy(*C).agg(F.sum("w").alias("cw"), *ends).withColumn("cell", F.monotonically_increasing_id()))
    placed = materialize(celled.join(cells.select("cell", "cw", *C), C).select("pid", "w", *X, "cell", "cw"))
    near = _near_cells(cells, d, eps2)
    around = near.select(F.col("a").alias("cell"), F.col("b").alias("other")).unionByName(near.select(F.col("b").alias("cell"), F.col("a").alias("other")))

    cores = _cores(placed, around, _Boxes(placed, d, origin, side), eps2, min_pts)
    flagged = placed.join(cores.withColumn("few", F.lit(True)), "pid", "left")
    flagged = materialize(flagged.select("pid", "w", *X, "cell", ((F.col("cw") >= min_pts) | F.col("few").isNotNull()).alias("core")))
    boxes = _Boxes(flagged.where("core"), d, origin, side)
    labels = _linked(near, boxes, eps2)
    inside = flagged.where("core").select("pid", F.col("cell").alias("node")).join(labels, "node").select("pid", "label")
    border = _border(flagged.where("NOT core"), around, boxes, labels, eps2)
    named = flagged.select("pid", "core").join(inside.unionByName(border), "pid", "left")
    named = named.select("pid", F.coalesce("label", F.lit(-1).cast("long")).alias("label"), F.col("core").alias("is_core"))
    return members.join(named, "pid").select("id", "label", "is_core")


def dbscan_summary(labels: DataFrame) -> DataFrame:
    """X1 + C8 report: clusters (noise excluded), noise share in percent (1 dp), core points."""
    return labels.agg(
        F.count_distinct(F.when(F.col("label") != -1, F.col("label"))).alias("clusters"),
        F.round(F.avg((F.col("label") == -1).cast("double")) * 100, 1).alias("noise_pct"),
        F.sum(F.col("is_core").cast("long")).alias("core_points"),
        F.count(F.lit(1)).alias("points"),
    )
