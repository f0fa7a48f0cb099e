import duckdb
import pytest

SF = "/root/testdata/sf0.001"
SOME = ["octree_tile_counts_p3", "quadtree_tile_counts_p2", "grid_cell_counts", "hierarchy_rollup", "small_tile_compaction", "merge_quadtree", "feature_lod_assign", "pnts_header_bytes", "pnts_roundtrip", "triangulated_area", "batch_table_json",
        "b3dm_header_bytes", "b3dm_contents", "earcut_shapes", "triangle_normals", "polygon_signed_area", "poisson_sample", "lod_build", "lod_build_p3", "root_overview",
        "merge_world_boxes", "subtree_error_sum", "reproject_lambert", "reproject_back", "fraction_filter", "linear_algebra", "feature_lod_top20"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, con, name):
    import __spark_entry__ as e

    df = e.queries()[name](spark, SF)
    rel = con.sql(e.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
