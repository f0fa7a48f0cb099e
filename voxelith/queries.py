"""The registered queries over the shared tables, and their DuckDB SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelith import algebra_queries, clouds
from voxelith.clouds import CLOUD_SQL
from voxelith.functions import codec, color, crs, index, linalg, mesh
from voxelith.operators import features, lod, tiling
from voxelith.operators.tables import materialize
from voxelith.plans import convert, merge
from voxelith.sources import tiles, wkb, xyz

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CLOUDS = {"p1": clouds.p1, "p1q": clouds.p1q, "p2": clouds.p2, "p3": clouds.p3}
#: Levels at which the tile queries look, and the split threshold that small inputs reach.
LEVELS = {"p1": 4, "p1q": 4, "p2": 5, "p3": 3}
SMALL_SPLIT = 2000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# SQL for the tile tree: the same steps, level by level

_DIAGONAL = "sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) + (z1 - z0) * (z1 - z0))"
_D = lambda v: f"cast('{v}' as double)"


def _box_sql(cloud: str) -> str:
    return f"pts as ({cloud}), box as (select min(x) x0, min(y) y0, min(z) z0, max(x) x1, max(y) y1, max(z) z1 from pts)"


def tree_sql(cloud: str, levels: int, extra: str = "") -> str:
    """CTEs t0..t<levels>: points with path and box."""
    parts = [_box_sql(cloud), "t0 as (select x, y, z" + extra + ", x0, y0, z0, x1, y1, z1, '' as path from pts, box)"]
    for i in range(levels):
        flat = f"coalesce((z1 - z0) / nullif(least(x1 - x0, y1 - y0), 0) < {_D(0.5)}, false)"
        bit = lambda c: f"case when {c}1 > {c}0 and {c} - ({c}0 + {c}1) / 2 >= 0 then 1 else 0 end"
        parts.append(f"f{i} as (select *, {flat} as flat, {bit('x')} as bx, {bit('y')} as by_, {bit('z')} as bzz from t{i})")
        parts.append(f"g{i} as (select * exclude (bzz), case when flat then 0 else bzz end as bz from f{i})")
        lo = lambda c, b: f"case when {b} = 1 then ({c}0 + {c}1) / 2 else {c}0 end as {c}0"
        hi = lambda c, b: f"case when {b} = 1 then {c}1 else ({c}0 + {c}1) / 2 end as {c}1"
        zlo = "case when not flat and bz = 1 then (z0 + z1) / 2 else z0 end as z0"
        zhi = "case when flat or bz = 1 then z1 else (z0 + z1) / 2 end as z1"
        parts.append(
            f"t{i + 1} as (select x, y, z{extra}, {lo('x', 'bx')}, {lo('y', 'by_')}, {zlo}, {hi('x', 'bx')}, {hi('y', 'by_')}, {zhi}, path || cast(4 * bx + 2 * by_ + bz as varchar) as path from g{i})"
        )
    return "with " + ", ".join(parts)


_STATS = "count(*) as n, min(x) as x0, min(y) as y0, min(z) as z0, max(x) as x1, max(y) as y1, max(z) as z1"


def _tiles(s: SparkSession, d: str, cloud: str = "p1") -> DataFrame:
    return tiling.tile_stats(index.with_paths(CLOUDS[cloud](s, d), LEVELS[cloud]))


def _tiles_sql(cloud: str = "p1") -> str:
    n = LEVELS[cloud]
    return tree_sql(CLOUD_SQL[cloud], n) + f", tiles as (select path, {_STATS} from t{n} group by path)"


# flagship and per-cloud queries

for _c in CLOUDS:
    query(f"cloud_aabb_{_c}", f"with {_box_sql(CLOUD_SQL[_c])} select * from box")(lambda s, d, c=_c: index.bounds(CLOUDS[c](s, d)))
    query(
        f"cloud_spacing_scale_{_c}",
        f"with {_box_sql(CLOUD_SQL[_c])}, sp as (select {_DIAGONAL} / 125 as spacing from box) select round(spacing, 6) as spacing, "
        f"case when spacing > 10 then {_D(0.01)} when spacing > 1 then {_D(0.1)} else {_D(1)} end as scale from sp",
    )(lambda s, d, c=_c: tiling.metadata(CLOUDS[c](s, d)).select(F.round("spacing", 6).alias("spacing"), "scale"))
    query(
        f"subdivision_type_{_c}",
        f"with {_box_sql(CLOUD_SQL[_c])} select case when (z1 - z0) / nullif(least(x1 - x0, y1 - y0), 0) < {_D(0.5)} then 'QUADTREE' else 'OCTREE' end as subdivision from box",
    )(lambda s, d, c=_c: tiling.metadata(CLOUDS[c](s, d)).select("subdivision"))
    query(
        f"child_index_histogram_{_c}",
        tree_sql(CLOUD_SQL[_c], 1) + " select cast(path as int) as digit, count(*) as n from t1 group by 1",
    )(lambda s, d, c=_c: index.with_paths(CLOUDS[c](s, d), 1).groupBy(F.col("path").cast("int").alias("digit")).agg(F.count("*").alias("n")))
    _name = {"p1": "octree_tile_counts", "p1q": "quadtree_tile_counts", "p2": "quadtree_tile_counts_p2", "p3": "octree_tile_counts_p3"}[_c]
    query(_name, _tiles_sql(_c) + " select path, n, x0, z1 from tiles")(lambda s, d, c=_c: _tiles(s, d, c).select("path", "n", "x0", "z1"))


@query("tile_tight_bbox", _tiles_sql() + " select * from tiles")
def tile_tight_bbox(s, d):
    return _tiles(s, d)


@query(
    "tile_geometric_error",
    _tiles_sql()
    + f", sp as (select {_DIAGONAL} / 125 as s from box), m as (select s, case when s > 10 then {_D(0.01)} when s > 1 then {_D(0.1)} else {_D(1)} end as c from sp)"
    + " select path, round(10 * (s * c) / pow(2, length(path) + 1) / c, 6) as geometric_error from tiles, m",
)
def tile_geometric_error(s, d):
    meta = tiling.metadata(clouds.p1(s, d)).select("spacing", "scale")
    space = F.col("spacing") * F.col("scale")
    return _tiles(s, d).crossJoin(F.broadcast(meta)).select("path", F.round(index.geometric_error(space, F.col("scale")), 6).alias("geometric_error"))


_MID = ", ".join(f"({c}0 + {c}1) / 2 as c{c}, ({c}1 - {c}0) / 2 as h{c}" for c in "xyz")


@query("tile_bounding_volume", _tiles_sql() + f" select path, {_MID} from tiles")
def tile_bounding_volume(s, d):
    v = _tiles(s, d).select("path", index.volume().alias("v"))
    return v.select("path", *[F.col("v")[i].alias(n) for i, n in ((0, "cx"), (3, "hx"), (1, "cy"), (7, "hy"), (2, "cz"), (11, "hz"))])


@query(
    "tile_bounds_from_path",
    tree_sql(CLOUD_SQL["p1q"], 4) + " select distinct path, x0, y0, z0, x1, y1, z1 from t4",
)
def tile_bounds_from_path(s, d):
    pts = clouds.p1q(s, d)
    paths = index.with_paths(pts, 4).select("path").distinct()
    return index.box_of_path(paths, index.bounds(pts), 4).select("path", *index.BOX)


@query(
    "tile_file_names",
    _tiles_sql() + ", deep as (select path || path || path as path from tiles) select path, case when length(path) <= 8 then 'r' || path else substr(path, 1, 8) || '/r' || substr(path, 9) end || '.pnts' as name from deep",
)
def tile_file_names(s, d):
    return _tiles(s, d).select(F.repeat("path", 3).alias("path")).select("path", index.tile_file().alias("name"))


_CELL3 = lambda c: f"least(greatest(cast(trunc(3 * ({c} - {c}0) / nullif({c}1 - {c}0, 0)) as int), 0), 2)"


@query(
    "grid_cell_counts",
    f"with {_box_sql(CLOUD_SQL['p3'])} select {_CELL3('x')} + ({_CELL3('y')} << 2) + ({_CELL3('z')} << 4) as cell, count(*) as n from pts, box group by 1",
)
def grid_cell_counts(s, d):
    p = clouds.p3(s, d)
    return p.crossJoin(F.broadcast(index.bounds(p))).groupBy(index.cell_key().alias("cell")).agg(F.count("*").alias("n"))


for _c in ("p1", "p1q"):
    query(
        f"leaf_vs_internal_{_c}",
        tree_sql(CLOUD_SQL[_c], 1)
        + f", sp as (select {_DIAGONAL} / 125 as s from box), k as (select path, count(*) as n from t1 group by path) select path, n, (n < {SMALL_SPLIT} or s / 2 <= {_D(0.001)}) as is_leaf from k, sp",
    )(lambda s, d, c=_c: tiling.split_kinds(CLOUDS[c](s, d), SMALL_SPLIT))

# hierarchy

_UP = ", up as (select tiles.*, substr(path, 1, k) as ancestor from tiles, range(0, 5) r(k) where k <= length(path))"


@query(
    "hierarchy_rollup",
    _tiles_sql() + _UP + " select ancestor as path, cast(sum(n) as bigint) as n, min(x0) as x0, min(y0) as y0, min(z0) as z0, max(x1) as x1, max(y1) as y1, max(z1) as z1 from up group by 1",
)
def hierarchy_rollup(s, d):
    return tiling.rollup(_tiles(s, d))


@query(
    "ancestor_join",
    _tiles_sql() + _UP + ", above as (select distinct substr(path, 1, 2) as path from tiles where n > 100) select up.path, ancestor from up join above on ancestor = above.path where ancestor <> up.path",
)
def ancestor_join(s, d):
    t = materialize(_tiles(s, d).select("path", "n"), "tiles")
    return tiling.ancestor_join(t, t.where("n > 100").select(F.substring("path", 1, 2).alias("path")))


_ALL = _UP + ", every as (select ancestor as path, cast(sum(n) as bigint) as n from up group by 1)"


@query("parent_child_join", _tiles_sql() + _ALL + " select p.path as parent, c.path, c.n, p.n as parent_n from every c join every p on c.path <> '' and p.path = substr(c.path, 1, length(c.path) - 1)")
def parent_child_join(s, d):
    return tiling.parent_child(tiling.rollup(_tiles(s, d)))


@query("child_semi_join", _tiles_sql() + _ALL + " select path, n from every e where exists (select 1 from every c where c.path <> '' and substr(c.path, 1, length(c.path) - 1) = e.path)")
def child_semi_join(s, d):
    return tiling.internal(tiling.rollup(_tiles(s, d))).select("path", "n")


@query("leaf_anti_join", _tiles_sql() + _ALL + " select path, n from every e where not exists (select 1 from every c where c.path <> '' and substr(c.path, 1, length(c.path) - 1) = e.path)")
def leaf_anti_join(s, d):
    return tiling.leaves(tiling.rollup(_tiles(s, d))).select("path", "n")


def _compact_sql() -> str:
    out = _tiles_sql("p1q") + ", m4 as materialized (select path, n, path as target from tiles)"
    for depth in range(4, 0, -1):
        out += f", s{depth} as materialized (select target, sum(n) as s from m{depth} group by target)"
        out += f", m{depth - 1} as materialized (select path, n, case when length(m.target) = {depth} and s < 100 then substr(m.target, 1, {depth - 1}) else m.target end as target from m{depth} m join s{depth} s on m.target = s.target)"
    return out + " select path, n, target from m0"


@query("small_tile_compaction", _compact_sql())
def small_tile_compaction(s, d):
    return tiling.compact(_tiles(s, d, "p1q").select("path", "n"))


@query("box_prune", _tiles_sql() + " select path, n from tiles where x0 <= 30000 and x1 >= 10000 and y0 <= 1500 and y1 >= 500 and z0 <= 40000 and z1 >= 10000")
def box_prune(s, d):
    return tiling.prune_box(_tiles(s, d), (10000, 500, 10000), (30000, 1500, 40000)).select("path", "n")


# sampling

_VOX = ", ".join(f"cast(floor({c} / {_D(0.25)}) as bigint) as v{c}" for c in "xyz")


@query(
    "voxel_first_sample",
    f"with pts as ({CLOUD_SQL['p3']}), v as (select *, {_VOX} from pts), r as (select *, row_number() over (partition by vx, vy, vz order by x, y, z) as k, count(*) over (partition by vx, vy, vz) as n from v) select vx, vy, vz, x, y, z, n from r where k = 1",
)
def voxel_first_sample(s, d):
    return tiling.voxel_first(clouds.p3(s, d), 0.25)


_CELL3P = lambda c: f"least(greatest(cast(trunc(3 * ({c} - {c}0) / nullif({c}1 - {c}0, 0)) as int), 0), 2)"
_CELL_KEY = f"{_CELL3P('x')} + ({_CELL3P('y')} << 2) + ({_CELL3P('z')} << 4)"


def greedy_sql(name: str, points: str, group: str, order: str, keep: str) -> str:
    """CTEs: <name>r ranks the rows of `points` (x, y, z, gap, ...) within group; <name> walks each
    group in order and says of each row whether it is kept, `held` being the kept ones so far."""
    far = "(h.x - x) * (h.x - x) + (h.y - y) * (h.y - y) + (h.z - z) * (h.z - z) < gap * gap"
    own = "struct_pack(x := x, y := y, z := z)"
    cols = ", ".join(f"r.{c}" for c in keep.split(", "))
    return (
        f"{name}r as (select *, row_number() over (partition by {group} order by {order}) as k from {points}), "
        f"{name} as (select {keep}, {group}, x, y, z, k, true as kept, [{own}] as held from {name}r where k = 1 union all "
        f"select {keep}, {group}, x, y, z, k, ok, case when ok then list_append(held, {own}) else held end from (select {cols}, "
        + ", ".join(f"r.{g}" for g in group.split(", "))
        + f", r.x, r.y, r.z, r.k, s.held, len(list_filter(s.held, lambda h: {far.replace(' x)', ' r.x)').replace(' y)', ' r.y)').replace(' z)', ' r.z)').replace('gap', 'r.gap')})) = 0 as ok "
        f"from {name} s join {name}r r on " + " and ".join(f"r.{g} = s.{g}" for g in group.split(", ")) + " and r.k = s.k + 1))"
    )


@query(
    "poisson_sample",
    f"with recursive pts as (select *, vec_id from ({CLOUD_SQL['p3'].replace(' from', ', vec_id from')})), box as (select min(x) x0, min(y) y0, min(z) z0, max(x) x1, max(y) y1, max(z) z1 from pts), "
    f"b as (select vec_id, x, y, z, {_CELL_KEY} as cell, {_DIAGONAL} / 125 * 8 as gap from pts, box), " + greedy_sql("g", "b", "cell", "vec_id", "vec_id") + " select vec_id, cell, kept from g",
)
def poisson_sample(s, d):
    p = clouds.p3(s, d, "vec_id")
    meta = tiling.metadata(p).select(*index.BOX, (F.col("spacing") * 8).alias("gap"))
    boxed = p.crossJoin(F.broadcast(meta)).withColumn("cell", index.cell_key())
    return lod.sample(boxed, ("cell",), "gap", ("vec_id",)).select("vec_id", "cell", "kept")


def lod_sql(cloud: str, key: str, order: str, threshold: int, levels: int) -> str:
    """(path, depth, n) of a tree of at most `levels`, level by level as it is built."""
    out = f"with recursive pts as (select * from ({cloud})), box as (select min(x) x0, min(y) y0, min(z) z0, max(x) x1, max(y) y1, max(z) z1 from pts), sp as (select {_DIAGONAL} / 125 as root from box), "
    out += f"rest0 as (select {key}, x, y, z, x0, y0, z0, x1, y1, z1, '' as path from pts, box)"
    bit = lambda c: f"case when {c}1 > {c}0 and {c} - ({c}0 + {c}1) / 2 >= 0 then 1 else 0 end"
    lo = lambda c, b: f"case when {b} = 1 then ({c}0 + {c}1) / 2 else {c}0 end as {c}0"
    hi = lambda c, b: f"case when {b} = 1 then {c}1 else ({c}0 + {c}1) / 2 end as {c}1"
    done = []
    for n in range(1, levels + 1):
        out += f", f{n} as (select *, coalesce((z1 - z0) / nullif(least(x1 - x0, y1 - y0), 0) < {_D(0.5)}, false) as flat, {bit('x')} as bx, {bit('y')} as by_, {bit('z')} as bzz from rest{n - 1})"
        out += f", g{n} as (select *, case when flat then 0 else bzz end as bz from f{n})"
        zs = "case when not flat and bz = 1 then (z0 + z1) / 2 else z0 end as z0, case when flat or bz = 1 then z1 else (z0 + z1) / 2 end as z1"
        out += f", t{n} as materialized (select {key}, x, y, z, {lo('x', 'bx')}, {lo('y', 'by_')}, {hi('x', 'bx')}, {hi('y', 'by_')}, {zs}, path || cast(4 * bx + 2 * by_ + bz as varchar) as path from g{n})"
        out += f", big{n} as materialized (select path from t{n}, sp group by path, root having {n < levels} and count(*) >= {threshold} and root / {2**n} > {_D(0.001)})"
        out += f", in{n} as materialized (select t.*, {_CELL_KEY} as cell, root / {2**n} as gap from t{n} t join big{n} using (path), sp), "
        out += greedy_sql(f"k{n}", f"in{n}", "path, cell", order, key + ", x0, y0, z0, x1, y1, z1")
        out += f", rest{n} as materialized (select {key}, x, y, z, x0, y0, z0, x1, y1, z1, path from k{n} where not kept)"
        done += [f"select path, {n} as depth from t{n} where path not in (select path from big{n})", f"select path, {n} as depth from k{n} where kept"]
    return out + " select path, depth, count(*) as n from (" + " union all ".join(done) + ") group by 1, 2"


@query("lod_build", lod_sql(CLOUD_SQL["p1"].replace(" from", ", l_orderkey from"), "l_orderkey", "x, y, z", SMALL_SPLIT, 4))
def lod_build(s, d):
    return lod.build(clouds.p1(s, d, "l_orderkey"), SMALL_SPLIT, 4).groupBy("path", "depth").agg(F.count("*").alias("n"))


@query("lod_build_p3", lod_sql(CLOUD_SQL["p3"].replace(" from", ", vec_id from"), "vec_id", "vec_id", 30, 6))
def lod_build_p3(s, d):
    return lod.build(clouds.p3(s, d, "vec_id"), 30, 6, ("vec_id",)).groupBy("path", "depth").agg(F.count("*").alias("n"))


@query(
    "root_overview",
    f"with recursive {_box_sql(CLOUD_SQL['p3'])}, b as (select x, y, z, {_CELL_KEY} as cell, {_DIAGONAL} / 125 * 4 as gap, 1 as one from pts, box), " + greedy_sql("g", "b", "cell", "x, y, z", "one") + " select x, y, z from g where kept",
)
def root_overview(s, d):
    p = clouds.p3(s, d)
    tiled = index.with_paths(p, 1).select("x", "y", "z", "path").withColumn("depth", F.lit(1))
    return lod.overview(tiled, tiling.metadata(p).first()["spacing"] * 4)


@query(
    "merge_overview_sample",
    "with pts as (select l_extendedprice as x, cast(l_partkey as double) as y, l_quantity * 1000 as z, l_suppkey from lineitem), n as (select l_suppkey, count(*) as n from pts group by 1), t as (select sum(n) as t from n), "
    f"k as (select l_suppkey, cast(floor(n * least({_D(0.5)}, 5000.0 / t)) as bigint) as take from n, t), r as (select pts.*, take, row_number() over (partition by pts.l_suppkey order by x, y, z) as rk from pts join k using (l_suppkey)) "
    "select l_suppkey, count(*) as n, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from r where rk <= take group by 1",
)
def merge_overview_sample(s, d):
    out = tiling.overview_sample(clouds.p1(s, d, "l_suppkey"), "l_suppkey", 5000)
    return out.groupBy("l_suppkey").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))])


def _sets(s: SparkSession, d: str) -> DataFrame:
    return index.bounds(clouds.p1(s, d, F.col("l_suppkey").alias("id")), "id")


_SETS_SQL = "sets as (select l_suppkey as id, min(l_extendedprice) x0, min(cast(l_partkey as double)) y0, min(l_quantity * 1000) z0, max(l_extendedprice) x1, max(cast(l_partkey as double)) y1, max(l_quantity * 1000) z1 from lineitem group by 1)"


def _quadrants_sql(levels: int) -> str:
    out = f"with {_SETS_SQL}, q0 as (select id, (s.x0 + s.x1) / 2 as x, (s.y0 + s.y1) / 2 as y, b.x0, b.y0, b.x1, b.y1, '' as path from sets s, (select min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 from sets) b)"
    for i in range(levels):
        mx, my = "(x0 + x1) / 2", "(y0 + y1) / 2"
        out += f", q{i + 1} as (select id, x, y, case when x >= {mx} then {mx} else x0 end as x0, case when y >= {my} then {my} else y0 end as y0, case when x >= {mx} then x1 else {mx} end as x1, case when y >= {my} then y1 else {my} end as y1, path || cast(4 * (x >= {mx})::int + 2 * (y >= {my})::int as varchar) as path from q{i})"
    return out


@query("merge_quadrants", _quadrants_sql(4) + " select id, path, x0, x1 from q4")
def merge_quadrants(s, d):
    return merge.quadrant_paths(_sets(s, d), 4).select("id", "path", "x0", "x1")


@query(
    "merge_quadtree",
    _quadrants_sql(6)
    + ", e as (select id, path as full_path, substr(path, 1, k) as path, k from q6, range(0, 7) r(k)), a as (select path, min(id) as id, min(k) as k from e group by path having count(*) = 1), m as (select id, min(k) as k from a group by id) select q6.id, case when m.k is null then q6.path else substr(q6.path, 1, m.k) end as path from q6 left join m on m.id = q6.id",
)
def merge_quadtree(s, d):
    return merge.quadtree(_sets(s, d), 6)


@query(
    "quadtree_split",
    f"with {_box_sql(CLOUD_SQL['p1'])}, d as (select unnest([0, 2, 4, 6]) as digit) select digit, case when digit >= 4 then (x0 + x1) / 2 else x0 end as x0, case when digit >= 4 then x1 else (x0 + x1) / 2 end as x1, case when digit in (2, 6) then (y0 + y1) / 2 else y0 end as y0, case when digit in (2, 6) then y1 else (y0 + y1) / 2 end as y1, z0, z1 from box, d",
)
def quadtree_split(s, d):
    return index.quadrants(index.bounds(clouds.p1(s, d)))


# features

_ORDER_BOX = "select l_orderkey as fid, min(l_extendedprice) x0, min(cast(l_partkey as double)) y0, min(l_quantity) z0, max(l_extendedprice) x1, max(cast(l_partkey as double)) y1, max(l_quantity) z1, max(l_quantity) as weight from lineitem group by 1"


def _features(s: SparkSession, d: str) -> DataFrame:
    li = clouds.table(s, d, "lineitem")
    cols = {"x": F.col("l_extendedprice"), "y": F.col("l_partkey").cast("double"), "z": F.col("l_quantity")}
    return li.groupBy(F.col("l_orderkey").alias("fid")).agg(
        *[F.min(v).alias(f"{c}0") for c, v in cols.items()], *[F.max(v).alias(f"{c}1") for c, v in cols.items()], F.max("l_quantity").alias("weight")
    )


_CELLS = "c as (select f.*, " + ", ".join(
    f"cast(least(floor(((f.{c}0 + f.{c}1) / 2 - e.{c}0) / 2000), greatest(ceil((e.{c}1 - e.{c}0) / 2000), 1) - 1) as int) as {n}" for c, n in (("x", "i"), ("y", "j"))
) + ", e.x0 as ex, e.y0 as ey from f, (select min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 from f) e)"


@query("feature_grid_join", f"with f as ({_ORDER_BOX}), {_CELLS} select i, j, count(*) as n, sum(weight) as weight from c group by 1, 2")
def feature_grid_join(s, d):
    return features.contained(_features(s, d))


@query(
    "feature_lod_top20",
    f"with f as ({_ORDER_BOX}), {_CELLS}, r as (select fid, i, j, row_number() over (partition by i, j order by weight desc, fid) as k from c) select fid, i, j from r where k <= 20",
)
def feature_lod_top20(s, d):
    cells = features.grid_cell(_features(s, d))
    return cells.withColumn("k", F.row_number().over(Window.partitionBy("i", "j").orderBy(F.col("weight").desc(), "fid"))).where("k <= 20").select("fid", "i", "j")


def _assign_sql(most: int = 3, boxes: str = _ORDER_BOX, side: float = 2000.0) -> str:
    out = f"with f as ({boxes}), {_CELLS.replace('/ 2000', f'/ {side:g}')}, t0 as (select fid, weight, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy, ex + i * {_D(side)} as u, ey + j * {_D(side)} as v, cast(i as varchar) || '_' || cast(j as varchar) as node from c)"
    for k in range(most + 1):
        out += f", r{k} as (select *, row_number() over (partition by node order by weight desc, fid) as k from t{k})"
        if k < most:
            side /= 2
            a, b, sep = f"cx >= u + {_D(side)}", f"cy >= v + {_D(side)}", "'_' || " if k == 0 else ""
            out += f", t{k + 1} as (select fid, weight, cx, cy, case when {a} then u + {_D(side)} else u end as u, case when {b} then v + {_D(side)} else v end as v, node || {sep}cast(2 * ({a})::int + ({b})::int as varchar) as node from r{k} where k > 20)"
    return out + " " + " union all ".join(f"select fid, node, {k} as depth from r{k}" + (" where k <= 20" if k < most else "") for k in range(most + 1))


@query("feature_lod_assign", _assign_sql())
def feature_lod_assign(s, d):
    return features.assign(_features(s, d), most=3).select("fid", "node", "depth")


@query("feature_bbox", f"select fid, x0, y0, z0, x1, y1, z1 from ({_ORDER_BOX})")
def feature_bbox(s, d):
    return _features(s, d).drop("weight")


@query("feature_axis_swap", f"select fid, x0, x1, -z1 as y0, -z0 as y1, y0 as z0, y1 as z1 from ({_ORDER_BOX})")
def feature_axis_swap(s, d):
    return features.swap_up(_features(s, d)).select("fid", "x0", "x1", "y0", "y1", "z0", "z1")


# transforms

_M = [[0.5, -0.25, 0.125, 10.0], [2.0, 1.0, -1.0, -5.0], [0.0, 0.25, 4.0, 0.5]]


def _affine_sql(m, cloud: str = "p1") -> str:
    cols = ", ".join(" + ".join(f"{_D(v)} * {c}" for v, c in zip(r[:3], "xyz", strict=True)) + f" + {_D(r[3])} as t{n}" for r, n in zip(m, "xyz", strict=True))
    return f"with p as ({CLOUD_SQL[cloud]}) select x, y, z, {cols} from p"


def _affine(p: DataFrame, m) -> DataFrame:
    return p.select("x", "y", "z", *[c.alias(f"t{n}") for c, n in zip(linalg.transform_point(np.vstack([np.array(m)[:3], [0, 0, 0, 1]])), "xyz", strict=True)])


@query("affine_transform", _affine_sql(_M))
def affine_transform(s, d):
    return _affine(clouds.p1(s, d), _M)


_ROT = linalg.rotation_matrix(0.7, [1, 2, 3], [4, 5, 6])


@query("rotate_about_axis", _affine_sql(_ROT[:3].tolist(), "p3"))
def rotate_about_axis(s, d):
    return _affine(clouds.p3(s, d), _ROT)


_ST = linalg.concatenate_matrices(linalg.translation_matrix([1, -2, 3]), linalg.scale_matrix(0.25))


@query("scale_translate", _affine_sql(_ST[:3].tolist(), "p2"))
def scale_translate(s, d):
    return _affine(clouds.p2(s, d), _ST)


@query(
    "quaternion_multiply",
    "with v as (select vec_id, " + ", ".join(f"cast(embedding[{i + 1}] as double) as q{i}" for i in range(8)) + " from embeddings) select vec_id, round(q0*q4 - q1*q5 - q2*q6 - q3*q7, 6) as w, round(q0*q5 + q1*q4 + q2*q7 - q3*q6, 6) as x, round(q0*q6 - q1*q7 + q2*q4 + q3*q5, 6) as y, round(q0*q7 + q1*q6 - q2*q5 + q3*q4, 6) as z from v",
)
def quaternion_multiply(s, d):
    v = clouds.table(s, d, "embeddings")
    q = [F.col("embedding")[i].cast("double") for i in range(8)]
    return v.select("vec_id", *[F.round(c, 6).alias(n) for c, n in zip(linalg.quaternion_product(q[:4], q[4:]), "wxyz", strict=True)])


@query(
    "euler_matrix_rows",
    "with e as (select distinct l_linenumber as k, " + ", ".join(f"cast(l_linenumber as double) * {_D(v)} as {c}" for v, c in ((0.1, "a"), (0.2, "b"), (0.3, "c"))) + " from lineitem) "
    "select k, round(cos(b) * cos(c), 6) as m00, round(cos(b) * sin(c), 6) as m10, round(-sin(b), 6) as m20, round(sin(a) * sin(b) * cos(c) - cos(a) * sin(c), 6) as m01, round(cos(a) * sin(b) * cos(c) + sin(a) * sin(c), 6) as m02 from e",
)
def euler_matrix_rows(s, d):
    keys = clouds.table(s, d, "lineitem").select(F.col("l_linenumber").alias("k")).distinct()

    def rows(frames):
        for f in frames:
            ms = [linalg.euler_matrix(0.1 * k, 0.2 * k, 0.3 * k) for k in f["k"]]
            yield f.assign(**{f"m{i}{j}": [round(float(m[i, j]), 6) + 0.0 for m in ms] for i, j in ((0, 0), (1, 0), (2, 0), (0, 1), (0, 2))})

    return keys.mapInPandas(rows, "k int, m00 double, m10 double, m20 double, m01 double, m02 double")


_LONLAT = "select c_custkey, cast(c_custkey % 360 - 180 as double) as lon, cast(c_custkey % 170 - 85 as double) as lat, c_acctbal as h from customer"
_N = "6378137 / sqrt(1 - {e2} * sin(radians(lat)) * sin(radians(lat)))".format(e2=_D((1 / 298.257223563) * (2 - 1 / 298.257223563)))


@query(
    "geodetic_to_ecef",
    f"with g as ({_LONLAT}), n as (select *, {_N} as n from g) select c_custkey, round((n + h) * cos(radians(lat)) * cos(radians(lon)), 3) as x, round((n + h) * cos(radians(lat)) * sin(radians(lon)), 3) as y, round((n * (1 - {_D((1 / 298.257223563) * (2 - 1 / 298.257223563))}) + h) * sin(radians(lat)), 3) as z from n",
)
def geodetic_to_ecef(s, d):
    g = clouds.table(s, d, "customer").selectExpr("c_custkey", "double(c_custkey % 360 - 180) as lon", "double(c_custkey % 170 - 85) as lat", "c_acctbal as h")
    return g.select("c_custkey", *[F.round(c, 3).alias(n) for c, n in zip(crs.to_ecef(F.col("lon"), F.col("lat"), F.col("h")), "xyz", strict=True)])


def _lambert_sql() -> str:
    """EPSG 3949 by the formulas of the conformal conic with two standard parallels, on GRS 80."""
    f = 1 / 298.257222101
    e = f"sqrt({_D(f * (2 - f))})"
    t = lambda p: f"(tan(pi() / 4 - {p} / 2) / pow((1 - {e} * sin({p})) / (1 + {e} * sin({p})), {e} / 2))"
    m = lambda p: f"(cos({p}) / sqrt(1 - {e} * {e} * sin({p}) * sin({p})))"
    out = "with g as (select c_custkey, radians(cast(c_custkey % 9 - 4 as double)) as lon, radians(cast(c_custkey % 8 + 42 as double)) as lat from customer), "
    out += f"k as (select radians({_D(48.25)}) as p1, radians({_D(49.75)}) as p2, radians({_D(49)}) as p0, radians({_D(3)}) as l0), "
    out += f"c as (select *, (ln({m('p1')}) - ln({m('p2')})) / (ln({t('p1')}) - ln({t('p2')})) as n from k), "
    out += f"d as (select *, 6378137 * {m('p1')} / (n * pow({t('p1')}, n)) as af from c) "
    return out + f"select c_custkey, round(1700000 + af * pow({t('lat')}, n) * sin(n * (lon - l0)), 3) as x, round(8200000 + af * pow({t('p0')}, n) - af * pow({t('lat')}, n) * cos(n * (lon - l0)), 3) as y from g, d"


@query("reproject_lambert", _lambert_sql())
def reproject_lambert(s, d):
    g = clouds.table(s, d, "customer").selectExpr("c_custkey", "double(c_custkey % 9 - 4) as lon", "double(c_custkey % 8 + 42) as lat", "double(0) as h")
    x, y, _ = crs.reproject(F.col("lon"), F.col("lat"), F.col("h"), 4326, 3949)
    return g.select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(
    "reproject_mercator",
    f"select c_custkey, round(6378137 * radians(lon), 3) + 0 as x, round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) + 0 as y from ({_LONLAT})",
)
def reproject_mercator(s, d):
    g = clouds.table(s, d, "customer").selectExpr("c_custkey", "double(c_custkey % 360 - 180) as lon", "double(c_custkey % 170 - 85) as lat", "double(0) as h")
    x, y, _ = crs.reproject(F.col("lon"), F.col("lat"), F.col("h"), 4326, 3857)
    return g.select("c_custkey", (F.round(x, 3) + 0.0).alias("x"), (F.round(y, 3) + 0.0).alias("y"))


def _utm_sql() -> str:
    """UTM zone 31 by Krueger's series, step by step."""
    f = "(1 / cast('298.257223563' as double))"
    out = "with g as (select c_custkey, radians(cast(c_custkey % 6 - 3 as double)) as l, radians(cast(c_custkey % 160 - 80 as double)) as p from customer), "
    out += f"k as (select {f} / (2 - {f}) as n, sqrt({f} * (2 - {f})) as e), "
    out += "s as (select g.*, k.*, sinh(asinh(tan(p)) - e * atanh(e * sin(p))) as t from g, k), "
    out += "r as (select *, atan2(t, cos(l)) as xi, atanh(sin(l) / sqrt(1 + t * t)) as eta, 6378137 / (1 + n) * (1 + n * n / 4 + pow(n, 4) / 64) as big, "
    out += "n / 2 - 2 * n * n / 3 + 5 * pow(n, 3) / 16 + 41 * pow(n, 4) / 180 as a1, 13 * n * n / 48 - 3 * pow(n, 3) / 5 + 557 * pow(n, 4) / 1440 as a2, 61 * pow(n, 3) / 240 - 103 * pow(n, 4) / 140 as a3, 49561 * pow(n, 4) / 161280 as a4 from s) "
    x = "eta + " + " + ".join(f"a{j} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j in range(1, 5))
    y = "xi + " + " + ".join(f"a{j} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j in range(1, 5))
    k = _D(0.9996)
    return out + f"select c_custkey, round(500000 + {k} * big * ({x}), 3) + 0 as x, round({k} * big * ({y}), 3) + 0 as y from r"


@query("reproject_utm", _utm_sql())
def reproject_utm(s, d):
    g = clouds.table(s, d, "customer").selectExpr("c_custkey", "double(c_custkey % 6) as lon", "double(c_custkey % 160 - 80) as lat", "double(0) as h")
    x, y, _ = crs.reproject(F.col("lon"), F.col("lat"), F.col("h"), 4326, 32631)
    return g.select("c_custkey", (F.round(x, 3) + 0.0).alias("x"), (F.round(y, 3) + 0.0).alias("y"))


@query("reproject_back", "select c_custkey, cast(c_custkey % 9 - 4 as double) as lon, cast(c_custkey % 8 + 42 as double) as lat, round(c_acctbal, 2) as h from customer")
def reproject_back(s, d):
    """Through a plane and a geocentric system back to where it began."""
    g = clouds.table(s, d, "customer").selectExpr("c_custkey", "double(c_custkey % 9 - 4) as lon", "double(c_custkey % 8 + 42) as lat", "c_acctbal as h")
    x, y, z = crs.reproject(F.col("lon"), F.col("lat"), F.col("h"), 4326, 3949)
    g = g.select("c_custkey", x.alias("x"), y.alias("y"), z.alias("z"))
    g = g.select("c_custkey", *[c.alias(f"e{n}") for c, n in zip(crs.reproject(F.col("x"), F.col("y"), F.col("z"), 3949, 4978), "xyz", strict=True)])
    lon, lat, h = crs.reproject(F.col("ex"), F.col("ey"), F.col("ez"), 4978, 4326)
    return g.select("c_custkey", (F.round(lon, 7) + 0.0).alias("lon"), F.round(lat, 7).alias("lat"), F.round(h, 2).alias("h"))


# colours, text, fractions


@query(
    "color_scale_wrap",
    f"select l_orderkey, l_linenumber, cast(trunc(l_extendedprice * {_D(1 / 257)}) as bigint) % 256 as r, cast(trunc(l_extendedprice) as bigint) % 256 as g from lineitem",
)
def color_scale_wrap(s, d):
    li = clouds.table(s, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", color.scaled(F.col("l_extendedprice"), 1 / 257).cast("long").alias("r"), color.scaled(F.col("l_extendedprice"), None).cast("long").alias("g"))


@query("intensity_to_gray", "select l_orderkey, case when l_linenumber % 2 = 0 then l_linenumber else cast(l_quantity as int) end as r, cast(l_quantity as int) as g from lineitem")
def intensity_to_gray(s, d):
    li = clouds.table(s, d, "lineitem").withColumn("i", F.col("l_quantity").cast("int"))
    r, g, _ = color.grey(F.col("i"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")), F.lit(None).cast("int"), F.lit(None).cast("int"))
    return li.select("l_orderkey", r.alias("r"), g.alias("g"))


@query("xyz_parse", "select cast(l_orderkey as double) as x, cast(l_partkey as double) as y, cast(l_suppkey as double) as z, case when l_linenumber % 2 = 1 then l_linenumber end as r from lineitem")
def xyz_parse(s, d):
    line = F.when(F.col("l_linenumber") % 2 == 0, F.concat_ws(" ", "l_orderkey", "l_partkey", "l_suppkey")).otherwise(F.concat_ws(" ", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linenumber", "l_linenumber"))
    return clouds.table(s, d, "lineitem").select(line.alias("value")).select(*xyz.parse()).select("x", "y", "z", "r")


@query("fraction_filter", "select l_orderkey, l_linenumber from lineitem where ('0x' || substr(md5(cast(l_orderkey as varchar) || '|' || cast(l_linenumber as varchar)), 1, 8))::bigint % 100 < 30")
def fraction_filter(s, d):
    return convert.fraction(clouds.table(s, d, "lineitem"), 30, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber")


_MORTON = " + ".join(f"((ix >> {i}) & 1) * {4**i} + ((iy >> {i}) & 1) * {2 * 4**i}" for i in range(15))


@query("morton_key", f"with p as (select distinct cast(l_partkey as bigint) as ix, cast(l_suppkey as bigint) as iy from lineitem) select ix, iy, {_MORTON} as z from p")
def morton_key(s, d):
    p = clouds.table(s, d, "lineitem").select(F.col("l_partkey").alias("ix"), F.col("l_suppkey").alias("iy")).distinct()
    return p.select("ix", "iy", index.morton().alias("z"))


# codecs

_WORD = lambda v: "concat(" + ", ".join(f"substr(lpad(printf('%X', {v}), 8, '0'), {i}, 2)" for i in (7, 5, 3, 1)) + ")"
_FT = "'{\"POINTS_LENGTH\":' || cast(n as varchar) || ',\"POSITION\":{\"byteOffset\":0},\"RGB\":{\"byteOffset\":' || cast(n * 12 as varchar) || '}}'"
_FT_SQL = _tiles_sql() + f", ft as (select path, n, {_FT} as t from tiles), fp as (select path, n, t || repeat(' ', cast(4 - (length(t) + 28) % 4 as int)) as t from ft)"


@query("feature_table_json", _FT_SQL + " select path, t as json from fp")
def feature_table_json(s, d):
    return _tiles(s, d).select("path", codec.feature_table_text(F.col("n"), rgb=True).alias("json"))


@query(
    "pnts_header_bytes",
    _FT_SQL + f", w as (select path, length(t) as j, n * 15 as b from fp) select path, '706E7473' || {_WORD('1')} || {_WORD('28 + j + b')} || {_WORD('j')} || {_WORD('b')} || '0000000000000000' as header from w",
)
def pnts_header_bytes(s, d):
    t = _tiles(s, d).select("path", F.length(codec.feature_table_text(F.col("n"), rgb=True)).alias("j"), (F.col("n") * 15).alias("b"))
    return t.select("path", codec.pnts_header_hex(F.col("j"), F.col("b")).alias("header"))


@query(
    "pnts_roundtrip",
    tree_sql(CLOUD_SQL["p1"], 2) + " select path, count(*) as n, cast(min(cast(x as float)) as double) as x0, cast(max(cast(y as float)) as double) as y1, cast(max(cast(z as float)) as double) as z1 from t2 group by path",
)
def pnts_roundtrip(s, d):
    coded = tiles.encode_tiles(index.with_paths(clouds.p1(s, d), 2)).select(F.col("path").alias("uri"), "content")
    back = tiles.tile_points(coded)
    return back.groupBy(F.col("uri").alias("path")).agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("z").alias("z1"))


@query("tile_header_decode", _tiles_sql() + " select path, 'pnts' as magic, 28 + length(t) + n * 12 as total from (select path, n, t || repeat(' ', cast(4 - (length(t) + 28) % 4 as int)) as t from (select path, n, '{\"POINTS_LENGTH\":' || cast(n as varchar) || ',\"POSITION\":{\"byteOffset\":0}}' as t from tiles))")
def tile_header_decode(s, d):
    coded = tiles.encode_tiles(index.with_paths(clouds.p1(s, d), 4))
    return coded.select("path", *codec.header_columns()).select("path", "magic", "total")


@query(
    "batch_table_json",
    "with b as (select p_brand, '{\"key\":[' || string_agg(cast(p_partkey as varchar), ',' order by p_partkey) || '],\"size\":[' || string_agg(cast(p_size as varchar), ',' order by p_partkey) || ']}' as t from part group by 1) select p_brand, t || repeat(' ', cast(4 - length(t) % 4 as int)) as json from b",
)
def batch_table_json(s, d):
    rows = F.sort_array(F.collect_list(F.struct("p_partkey", "p_size")))
    g = clouds.table(s, d, "part").groupBy("p_brand").agg(rows.alias("r")).select("p_brand", F.col("r.p_partkey").alias("key"), F.col("r.p_size").alias("size"))

    def encode(batches):
        for b in batches:
            texts = [codec.batch_table_json({"key": k, "size": n}).decode() for k, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts)], names=["p_brand", "json"])

    return g.mapInArrow(encode, "p_brand string, json string")


@query(
    "b3dm_header_bytes",
    "with b as (select p_brand, count(*) as n, '{\"id\":[' || string_agg(cast(p_partkey as varchar), ',' order by p_partkey) || ']}' as t from part group by 1), "
    "l as (select p_brand, cast(length(t) + 4 - length(t) % 4 as bigint) as b, cast(100 * n as bigint) as g from b) "
    f"select p_brand, '6233646D' || {_WORD('1')} || {_WORD('28 + b + g')} || '0000000000000000' || {_WORD('b')} || '00000000' as header from l",
)
def b3dm_header_bytes(s, d):
    g = clouds.table(s, d, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list("p_partkey")).alias("ids"))

    def encode(batches):
        for b in batches:
            heads = [codec.encode_b3dm(bytes(100 * len(ids)), {"id": ids})[:28].hex().upper() for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(heads)], names=["p_brand", "header"])

    return g.mapInArrow(encode, "p_brand string, header string")


# meshes

_FOOT = "select p_partkey as fid, cast(p_partkey % 100 as double) * 10 as x, cast(p_partkey // 100 as double) * 10 as y, cast(p_size as double) / 10 as w, p_retailprice / 1000 as h from part"
#: A footprint rises by these along x and y.
_TILT = "cast(p_size % 7 - 3 as double) / 4", "cast(p_partkey % 5 - 2 as double) / 4"


def _parts(s: SparkSession, d: str) -> DataFrame:
    tilt = [f"double({a} % {m} - {k}) / 4" for a, m, k in (("p_size", 7, 3), ("p_partkey", 5, 2))]
    return clouds.table(s, d, "part").selectExpr("p_partkey as fid", "double(p_partkey % 100) * 10 as x", "double(p_partkey div 100) * 10 as y", "double(p_size) / 10 as w", "p_retailprice / 1000 as h", f"{tilt[0]} as a", f"{tilt[1]} as b")


def _as_wkb(parts: DataFrame, shape, tilted: bool = False) -> DataFrame:
    """(fid, wkb) of parts; shape gives rings in units of w for a part's number.  Parts are dealt to all
    shuffle partitions first, as a file of them may be one task."""

    def rows(batches):
        for batch in batches:
            fid, x, y, w, h, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fid", "x", "y", "w", "h", "a", "b"))
            out = []
            for i in range(len(fid)):
                rings = []
                for ring in shape(int(fid[i])):
                    u = np.array(ring, float) * w[i]
                    z = h[i] + (a[i] * u[:, 0] + b[i] * u[:, 1] if tilted else 0 * u[:, 0])
                    rings.append(np.c_[u[:, 0] + x[i], u[:, 1] + y[i], z])
                out.append(mesh.write_wkb([rings]))
            yield pa.RecordBatch.from_arrays([batch.column("fid"), pa.array(out, pa.binary())], names=["fid", "wkb"])

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return parts.repartition(n).mapInArrow(rows, "fid long, wkb binary")


_SQUARE = [(0, 0), (1, 0), (1, 1), (0, 1)]
_HOLED = [_SQUARE, [(0.25, 0.75), (0.75, 0.75), (0.75, 0.25), (0.25, 0.25)]]


def _footprints(s: SparkSession, d: str) -> DataFrame:
    """A square with a square hole for each part, as WKB."""
    return _as_wkb(_parts(s, d), lambda i: _HOLED)


@query("polygon_signed_area", f"select fid, round(w * w * {_D(0.75)}, 6) as area from ({_FOOT})")
def polygon_signed_area(s, d):
    def rows(batches):
        for b in batches:
            areas = [round(sum(mesh.signed_area(r) for r in mesh.read_wkb(w)[0]) / 2, 6) for w in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(areas)], names=["fid", "area"])

    return _footprints(s, d).mapInArrow(rows, "fid long, area double")


@query("triangulated_area", f"select fid, round(w * w * {_D(0.75)}, 6) as area, round(h, 6) as z from ({_FOOT})")
def triangulated_area(s, d):
    t = wkb.boxes(wkb.triangles(_footprints(s, d)))
    return t.select("fid", F.round("weight", 6).alias("area"), F.round("z1", 6).alias("z"))


def _shape(i: int) -> list[list[tuple[float, float]]]:
    """A square with a hole, an L, a comb, two squares that touch in a corner, a hole that touches the
    outside, two holes that touch each other."""
    kind = i % 6
    if kind == 0:
        return _HOLED
    if kind == 1:
        return [[(0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1)]]
    if kind == 2:
        n = 2 + i % 5
        teeth = [p for k in range(n - 1, -1, -1) for p in (((2 * k + 1) / (2 * n), 0.25), ((2 * k + 1) / (2 * n), 0.75), (k / n, 0.75), (k / n, 0.25))]
        return [[(0, 0), (1, 0), (1, 0.25), *teeth]]
    if kind == 3:
        return [[(0, 0), (0.5, 0), (0.5, 0.5), (1, 0.5), (1, 1), (0.5, 1), (0.5, 0.5), (0, 0.5)]]
    if kind == 4:
        return [_SQUARE, [(0.5, 0), (0.25, 0.5), (0.75, 0.5)]]
    return [_SQUARE, [(0.5, 0.5), (0.125, 0.25), (0.25, 0.125)], [(0.5, 0.5), (0.875, 0.75), (0.75, 0.875)]]


@query(
    "earcut_shapes",
    f"select fid, round(w * w * case fid % 6 when 2 then {_D(0.5)} when 3 then {_D(0.5)} when 4 then {_D(0.875)} when 5 then {_D(1 - 2 * 0.0390625)} else {_D(0.75)} end, 6) as area from ({_FOOT})",
)
def earcut_shapes(s, d):
    t = wkb.boxes(wkb.triangles(_as_wkb(_parts(s, d), _shape)))
    return t.select("fid", F.round("weight", 6).alias("area"))


@query(
    "triangle_normals",
    f"with f as (select p_partkey as fid, {_TILT[0]} as a, {_TILT[1]} as b from part) select fid, round(-a / sqrt(1 + a * a + b * b), 6) + 0 as nx, round(-b / sqrt(1 + a * a + b * b), 6) + 0 as ny, round(1 / sqrt(1 + a * a + b * b), 6) as nz, 8 as n from f",
)
def triangle_normals(s, d):
    t = wkb.triangles(_as_wkb(_parts(s, d), lambda i: _HOLED, True))
    same = [F.round(F.avg(c), 6) + 0.0 for c in ("nx", "ny", "nz")]
    return t.groupBy("fid").agg(*[c.alias(n) for c, n in zip(same, ("nx", "ny", "nz"), strict=True)], F.count("*").cast("int").alias("n"))


_FOOT_BOX = f"select fid, x as x0, y as y0, h as z0, x + w as x1, y + w as y1, h as z1, round(w * w * {_D(0.75)}, 6) as weight from ({_FOOT})"
_B3DM_SQL = _assign_sql(3, _FOOT_BOX, 500.0)
_B3DM_AT = _B3DM_SQL.index(" select fid, node, 0 as depth")


@query(
    "b3dm_contents",
    _B3DM_SQL[:_B3DM_AT] + ", placed as (" + _B3DM_SQL[_B3DM_AT:] + ") select 'tiles/' || node || '.b3dm' as name, count(*) as features, 24 * count(*) as vertices, cast(count(*) - 1 as double) as last_batch, 672 * count(*) as body, cast(sum(fid) as bigint) as ids from placed group by node",
)
def b3dm_contents(s, d):
    """What the written files hold when they are read again: a mesh of 8 triangles for each feature."""
    from voxelith.plans.export import encode_nodes

    tri = materialize(wkb.triangles(_footprints(s, d)), "triangles")
    placed = features.assign(wkb.boxes(tri).withColumn("weight", F.round("weight", 6)), size=500.0, most=3)

    def decode(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head, body, table, _ = codec.decode_b3dm(content)
                acc = dict(zip(head["meshes"][0]["primitives"][0]["attributes"], head["accessors"], strict=True))
                rows.append((name, len(table["id"]), acc["POSITION"]["count"], acc["_BATCHID"]["max"][0], len(body), sum(table["id"])))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["name", "features", "vertices", "last_batch", "body", "ids"])

    return encode_nodes(tri, placed).select("name", "content").mapInArrow(decode, "name string, features long, vertices long, last_batch double, body long, ids long")


@query("event_props_parse", "select cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events group by 1")
def event_props_parse(s, d):
    return clouds.table(s, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))

# small operators


@query("average_minimum", f"with f as ({_ORDER_BOX}) select round(avg(x0), 4) as x, round(avg(y0), 4) as y, round(avg(z0), 4) as z from f")
def average_minimum(s, d):
    return _features(s, d).agg(*[F.round(F.avg(f"{c}0"), 4).alias(c) for c in "xyz"])


@query(
    "ring_signed_area",
    "with p as (select p_brand, p_partkey, cast(p_size as double) as x, p_retailprice as y from part), n as (select *, coalesce(lead(x) over w, first_value(x) over w) as nx, coalesce(lead(y) over w, first_value(y) over w) as ny from p window w as (partition by p_brand order by p_partkey)) select p_brand, round(sum(x * ny - nx * y) / 2, 4) as area from n group by 1",
)
def ring_signed_area(s, d):
    p = clouds.table(s, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return features.ring_areas(p, "p_brand", "p_partkey").select("p_brand", F.round("area", 4).alias("area"))


@query(
    "byte_offsets",
    "select p_brand, p_partkey, p_size * 12 as size, cast(coalesce(sum(p_size * 12) over (partition by p_brand order by p_partkey rows between unbounded preceding and 1 preceding), 0) as bigint) as offset_ from part",
)
def byte_offsets(s, d):
    p = clouds.table(s, d, "part").select("p_brand", "p_partkey", (F.col("p_size") * 12).alias("size"))
    return features.byte_offsets(p, "p_brand", "p_partkey", "size").withColumnRenamed("offset", "offset_")


_TRI = [(1000.0, 0.0), (60000.0, 100.0), (20000.0, 1800.0)]
_EDGES = [f"({_D(bx - ax)} * (y - {_D(ay)}) - {_D(by - ay)} * (x - {_D(ax)}))" for (ax, ay), (bx, by) in zip(_TRI, _TRI[1:] + _TRI[:1], strict=True)]


@query("point_in_triangle", f"with p as ({CLOUD_SQL['p1']}) select x, y from p where ({' and '.join(e + ' >= 0' for e in _EDGES)}) or ({' and '.join(e + ' <= 0' for e in _EDGES)})")
def point_in_triangle(s, d):
    return clouds.p1(s, d).where(features.in_triangle("x", "y", _TRI)).select("x", "y")


@query("half_open_inside", f"with p as ({CLOUD_SQL['p1']}) select x, y from p where x >= 10000 and x < 40000 and y >= 100 and y < 900")
def half_open_inside(s, d):
    return clouds.p1(s, d).where(features.inside("x", "y", (10000.0, 100.0), (40000.0, 900.0))).select("x", "y")


@query("distinct_children", _tiles_sql() + _ALL + " select substr(path, 1, length(path) - 1) as parent, count(distinct substr(path, length(path), 1)) as n from every where path <> '' group by 1")
def distinct_children(s, d):
    kids = tiling.with_parent(tiling.rollup(_tiles(s, d)).select("path")).where("path <> ''")
    return kids.groupBy("parent").agg(F.countDistinct(F.expr("right(path, 1)")).alias("n"))


@query("cloud_union", " union all ".join(f"select '{c}' as cloud, count(*) as n, min(x) as x0, max(z) as z1 from ({CLOUD_SQL[c]})" for c in CLOUDS))
def cloud_union(s, d):
    every = None
    for c, f in CLOUDS.items():
        own = f(s, d).select(F.lit(c).alias("cloud"), "x", "z")
        every = own if every is None else every.unionByName(own)
    return every.groupBy("cloud").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("z").alias("z1"))


def _tilesets(s: SparkSession, d: str, moved: bool) -> list[dict]:
    """A tileset for each supplier's points, every one with a transform and an error of its own; unless
    moved, the transform costs no digit of x and y, so that quadrants are those of the plain boxes."""
    quarter = np.array([[0, -1, 0, 0], [1, 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1.0]])
    out = []
    for r in sorted(_sets(s, d).collect(), key=lambda r: r["id"]):
        m = linalg.concatenate_matrices(linalg.translation_matrix([r["id"] * moved, -2 * r["id"] * moved, 5]), quarter, linalg.scale_matrix(0.25 * 2 ** (r["id"] % 3)))
        corners = np.array([[r[f"x{i & 1}"], r[f"y{i >> 1 & 1}"], r[f"z{i >> 2}"], 1] for i in range(8)]) @ linalg.inverse_matrix(m).T
        low, high = corners[:, :3].min(axis=0), corners[:, :3].max(axis=0)
        root = {"transform": linalg.column_major(m), "boundingVolume": {"box": [*((low + high) / 2).tolist(), *np.diag((high - low) / 2).ravel().tolist()]}}
        out.append({"id": r["id"], **merge.describe(f"file:///d/{r['id']}/tileset.json", json.dumps({"geometricError": r["id"] / 4, "root": root}))})
    return out


def _merged(s: SparkSession, d: str, levels: int, moved: bool) -> dict:
    sets = _tilesets(s, d, moved)
    frame = s.createDataFrame([(t["id"], *[t[k] for k in index.BOX]) for t in sets], "id long, " + ", ".join(f"{k} double" for k in index.BOX))
    paths = {r["id"]: r["path"] for r in merge.quadtree(frame, levels).collect()}
    return merge.assemble(sets, paths, np.array(sets[0]["transform"]).reshape(4, 4).T, "file:///d", True)


def _nodes(doc: dict):
    """The nodes of a tileset with the product of the transforms above and at them."""
    todo = [(doc["root"], np.eye(4))]
    while todo:
        n, m = todo.pop()
        m = m @ np.array(n.get("transform") or np.eye(4).ravel().tolist()).reshape(4, 4).T
        yield n, m
        todo += [(c, m) for c in n.get("children", [])]


@query("merge_world_boxes", f"with {_SETS_SQL} select id, " + ", ".join(f"round({k}, 5) as {k}" for k in index.BOX) + " from sets")
def merge_world_boxes(s, d):
    """Where the merged tileset puts its inputs, all transforms composed."""
    rows = []
    for n, m in _nodes(_merged(s, d, 4, True)):
        if n["content"]["uri"].endswith(".json"):
            corners = np.c_[merge.box_corners(n["boundingVolume"]["box"]), np.ones(8)] @ m.T
            rows.append((int(n["content"]["uri"].split("/")[0]), *[round(v, 5) + 0.0 for v in merge.to_box(corners[:, :3])]))
    return s.createDataFrame(rows, "id long, " + ", ".join(f"{k} double" for k in index.BOX))


@query(
    "subtree_error_sum",
    _quadrants_sql(4)
    + ", up as (select substr(path, 1, k) as path, id from q4, range(0, 5) r(k)), own as (select path, count(*) as n, sum(id) as e from up group by 1)"
    + " select 'r' || path || '.pnts' as uri, cast(e as double) / 4 as error from own where path = '' or n > 1",
)
def subtree_error_sum(s, d):
    """The errors of the merged tileset's inner nodes: the sum of the inputs' below."""
    rows = [(n["content"]["uri"], float(n["geometricError"])) for n, _ in _nodes(_merged(s, d, 4, False)) if n["content"]["uri"].endswith(".pnts")]
    return s.createDataFrame(rows, "uri string, error double")


@query("cubic_bounds", f"with {_box_sql(CLOUD_SQL['p2'])}, s as (select *, greatest(x1 - x0, y1 - y0, z1 - z0) as e from box) select x0, y0, z0, x0 + e as x1, y0 + e as y1, z0 + e as z1 from s")
def cubic_bounds(s, d):
    return index.bounds(clouds.p2(s, d)).select(*index.cubic())


query("linear_algebra", algebra_queries.SQL)(algebra_queries.linear_algebra)


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """How many points, and what tight box, each level-4 tile of the cloud has."""
    return _tiles(spark, sf_dir).orderBy("path")
