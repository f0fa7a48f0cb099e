"""Level of detail: greedy spacing-based sampling and the level loop that builds a tile tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.functions import index
from voxelith.operators.tables import materialize


#: Numbers that groups are hashed to.
CODES = 1 << 24
#: Cubes of a grid of kept points, at most; beyond that they are made larger.
CUBES = 1 << 20


class Held:
    """Kept points, by the cubes that they lie in.  A cube's edge is over `distance`, so that what is
    nearer than that lies in the same cube or next to it."""

    def __init__(self, distance: float, points: np.ndarray | None = None):
        self.distance, self.points, self.grid = distance, np.zeros((0, 3)), None
        if points is not None:
            self.add(points)

    def add(self, points: np.ndarray) -> None:
        if len(points):
            self.points, self.grid = np.concatenate([self.points, points]), None

    def _build(self) -> None:
        pts = self.points[np.isfinite(self.points).all(axis=1)]  # others are near nothing
        low = pts.min(axis=0) / 2 if len(pts) else np.zeros(3)  # halves do not overflow
        reach = pts.max(axis=0) / 2 - low if len(pts) else np.zeros(3)
        edge = self.distance * 1.001 / 2
        while np.prod(np.floor(reach / edge) + 3) > CUBES:
            edge *= 2
        cells = np.floor((pts / 2 - low) / edge).astype(np.int64) + 1
        dims = cells.max(axis=0) + 2 if len(pts) else np.full(3, 2)
        key = (cells[:, 0] * dims[1] + cells[:, 1]) * dims[2] + cells[:, 2]
        by = np.argsort(key, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=int(np.prod(dims))))])
        self.grid = low, edge, dims, start, np.ascontiguousarray(pts[by].T)

    @np.errstate(invalid="ignore", over="ignore")
    def near(self, points: np.ndarray) -> np.ndarray:
        """Which of points are nearer than `distance` to a kept one."""
        out = np.zeros(len(points), bool)
        if not len(self.points) or not self.distance > 0:
            return out
        if self.grid is None:
            self._build()
        low, edge, dims, start, (hx, hy, hz) = self.grid
        cells = np.floor((points / 2 - low) / edge)
        todo = np.nonzero(((cells >= -1) & (cells <= dims - 2)).all(axis=1))[0]
        c = cells[todo].astype(np.int64) + 1
        x, y, z = (np.ascontiguousarray(points[todo, i]) for i in range(3))
        d2 = self.distance * self.distance
        # Cubes that follow each other in z lie side by side: nine runs of three.
        for i, j in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1)):
            u, v, w = c[:, 0] + i, c[:, 1] + j, c[:, 2]
            row = (u * dims[1] + v) * dims[2]
            ok = (u >= 0) & (u < dims[0]) & (v >= 0) & (v < dims[1])
            row[~ok] = 0
            a = start[row + np.maximum(w - 1, 0)]
            b = np.where(ok, start[row + np.minimum(w + 2, dims[2])], 0)
            hit = np.zeros(len(todo), bool)
            at = np.nonzero(a < b)[0]
            while len(at):
                k = a[at]
                dx, dy, dz = x[at] - hx[k], y[at] - hy[k], z[at] - hz[k]
                close = dx * dx + dy * dy + dz * dz < d2
                hit[at[close]] = True
                a[at] += 1
                at = at[~close & (k + 1 < b[at])]
            out[todo[hit]] = True
            far = ~hit
            todo, c, x, y, z = todo[far], c[far], x[far], y[far], z[far]
            if not len(todo):
                break
        return out

    @np.errstate(invalid="ignore", over="ignore")
    def take(self, points: np.ndarray) -> np.ndarray:
        """Which of points, in order, are kept: those at least `distance` from all kept before; they
        are added."""
        kept = np.zeros(len(points), bool)
        left = np.nonzero(~self.near(points))[0]
        d2 = self.distance * self.distance
        for i in range(0, len(left), 1024):
            own = left[i : i + 1024]
            if i:
                own = own[~self.near(points[own])]
            x, y, z = (np.ascontiguousarray(points[own, k]) for k in range(3))
            while len(own):
                kept[own[0]] = True
                dx, dy, dz = x[1:] - x[0], y[1:] - y[0], z[1:] - z[0]
                far = np.nonzero(~(dx * dx + dy * dy + dz * dz < d2))[0] + 1
                own, x, y, z = own[far], x[far], y[far], z[far]
            new = left[i : i + 1024]
            self.add(points[new[kept[new]]])
        return kept


def greedy(points: np.ndarray, held: np.ndarray, distance: float) -> np.ndarray:
    """Which of points, in order, are kept: those at least `distance` from all of `held` and from
    every kept one before them."""
    return Held(distance, held).take(points)


def starts(batch: pa.RecordBatch, n: int) -> list[int]:
    """Where, in a batch, the first n columns' values begin to differ from the row's before; and its end."""
    cuts = np.zeros(batch.num_rows - 1, bool)
    for i in range(n):
        c = batch.column(i)
        if c.null_count or pa.types.is_nested(c.type):
            v = c.to_pylist()
            cuts |= np.fromiter((p != q for p, q in zip(v, v[1:], strict=False)), bool, len(cuts))
        else:
            cuts |= pc.not_equal(c.slice(1), c.slice(0, len(cuts))).to_numpy(zero_copy_only=False)
    return [0, *(np.nonzero(cuts)[0] + 1).tolist(), batch.num_rows]


def sample(points: DataFrame, group: tuple[str, ...], spacing: str | float, order: tuple[str, ...], lead: str | None = None) -> DataFrame:
    """points with `kept`: within each group, in `order`, a point is kept if it is at least
    `spacing` (a column, or a number) from every kept one before.

    Groups are hashed to partitions and sorted; a task streams through them and holds the kept
    points of one group only, which a cell's volume bounds, never a group's points.  A point is
    compared with the kept ones of the cubes around it, so its cost does not grow with their number.

    The rows are sorted by a number first, as Spark compares whole rows where the first values are
    equal: a hash of the group, plus `lead`, a column of 0 to 1 that nowhere falls in `order`, and that is
    not returned.  Groups of the same hash are held together."""
    fixed = spacing if isinstance(spacing, float) else None
    cols = list(dict.fromkeys([*group, *order, "x", "y", "z", *([] if fixed is not None else [spacing]), *(c for c in points.columns if c != lead)]))
    part = F.least(F.greatest(F.coalesce(F.col(lead), F.lit(0.0)), F.lit(0.0)), F.lit(1 - 2.0**-20)) if lead else F.lit(0.0)
    rank = (F.pmod(F.xxhash64(*group), F.lit(CODES)).cast("double") + part).alias("_rank")
    dealt = points.select(*cols, rank).repartition(*group).sortWithinPartitions("_rank", *group, *order)
    n = len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, held = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            xyz = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xyz"])
            codes = batch.column("_rank").to_numpy(zero_copy_only=False)
            kept = np.zeros(batch.num_rows, bool)
            cuts = starts(batch, n)
            for at, end in zip(cuts, cuts[1:], strict=False):
                if int(codes[at]) != code:
                    code, held = int(codes[at]), {}
                key = repr([batch.column(i)[at].as_py() for i in range(n)])
                if key not in held:
                    held[key] = Held(fixed if fixed is not None else batch.column(spacing)[at].as_py())
                kept[at:end] = held[key].take(xyz[at:end])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(kept)], names=[*cols, "kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema if f.name != "_rank") + ", kept boolean"
    return dealt.mapInArrow(run, schema)


def build(points: DataFrame, threshold: int = index.SPLIT_COUNT, most_levels: int = 24, order: tuple[str, ...] = ("x", "y", "z"), scale: float = 1.0) -> DataFrame:
    """points with path and depth: every point lies in exactly one tile.

    scale is what the points' coordinates have been multiplied with.  The root keeps none.  At each
    level a tile of fewer than `threshold` points, or of a spacing of at most a thousandth before
    scaling, keeps all; another keeps a greedy sample at its spacing, cell
    by cell, and hands the rest down.  A level's counts are a partial aggregate, its sample one
    shuffle by tile and cell, and each level's sample is written to the shared folder.  Boxes are
    kept a tile, not a point."""
    own = points.columns
    box = index.bounds(points).withColumn("_root", index.spacing())
    one = box.first()
    if one is None or one["x0"] is None:
        return points.withColumn("path", F.lit("")).withColumn("depth", F.lit(0))
    root = one["_root"]
    rest = points.crossJoin(F.broadcast(box.select(*index.BOX))).withColumn("path", F.lit(""))
    first = order[0]
    lead = F.expr(f"({first} - {first}0) / nullif({first}1 - {first}0, 0D)") if first in ("x", "y", "z") else F.lit(0.0)
    done: list[DataFrame] = []
    for level in range(1, most_levels + 1):
        space = root / 2**level
        rest = index.descend(rest)  # a projection: reading it twice costs less than writing it
        counts = rest.groupBy("path").agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in index.BOX])
        fine = space <= index.LEAST_SPACING * scale or level == most_levels
        big = materialize(counts.where(F.lit(not fine) & (F.col("_n") >= threshold)).select("path", *index.BOX), "big")
        done.append(rest.join(big.select("path"), "path", "left_anti").select(*own, "path", F.lit(level).alias("depth")))
        if not big.take(1):
            break
        inner = rest.join(big.select("path"), "path", "left_semi").select(*own, "path", index.cell_key().alias("_cell"), lead.alias("_lead"))
        picked = materialize(sample(inner, ("path", "_cell"), float(space), order, "_lead"), "picked")
        done.append(picked.where("kept").select(*own, "path", F.lit(level).alias("depth")))
        rest = picked.where("not kept").select(*own, "path").join(big, "path")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def overview(tiled: DataFrame, root_spacing: float, order: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """The root's overview tile: a greedy sample of the level-1 tiles at the root's spacing, twice
    theirs.  Its points are copies."""
    top = tiled.where("depth = 1").drop("path", "depth")
    boxed = top.crossJoin(F.broadcast(index.bounds(top)))
    boxed = boxed.withColumn("_cell", index.cell_key()).withColumn("_space", F.lit(float(root_spacing)))
    return sample(boxed, ("_cell",), "_space", order).where("kept").select(*top.columns)
