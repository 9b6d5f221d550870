import pytest
from pyspark.sql import functions as F

from plumbline.operators import rays, walls

RAY = "c int, ray int, ox double, oy double, oz double, dx double, dy double, dz double"


def test_first_hits(spark):
    r = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (1, 2, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0), (1, 3, 2.5, 0.0, 0.0, 1.0, 0.0, 0.0), (1, 4, 0.0, 5.0, 0.0, 1.0, 0.0, 0.0)], RAY)
    b = spark.createDataFrame([(1, "near", 2.0, -1.0, -1.0, 3.0, 1.0, 1.0), (1, "far", 5.0, -1.0, -1.0, 6.0, 1.0, 1.0)], "c int, box string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    assert {(x.ray, x.box, x.t) for x in rays.first_hits(r, b, ["c"]).collect()} == {(1, "near", 2.0), (3, "near", 0.5)}


@pytest.mark.parametrize(("x", "cell"), [(-0.1, None), (0.0, 0), (0.5, 0), (1.0, 1), (2.9, 1), (3.0, 1), (3.1, None)])
def test_cells_between_cuts(spark, x, cell):
    assert spark.range(1).select(rays.between(F.lit(x), F.array(*map(F.lit, (0.0, 1.0, 3.0)))).alias("k")).first().k == cell


def test_crossings_and_coordinates(spark):
    w = spark.createDataFrame([(1, "W", 0.0, 2.0, 4.0, 2.0, 0.0, -1.0, 0.0, 2.5)], "c int, wall string, sx double, sy double, ex double, ey double, nx double, ny double, z0 double, z1 double")
    r = spark.createDataFrame([(1, 1, 1.0, 0.0, 1.0, 1.0, 4.0, 2.0), (1, 2, 1.0, 0.0, 1.0, 1.0, 1.5, 1.0), (1, 3, 9.0, 0.0, 1.0, 9.0, 4.0, 1.0)], "c int, ray int, ox double, oy double, oz double, px double, py double, pz double")
    assert [(x.ray, x.u, x.z) for x in rays.crossings(r, w, ["c"]).collect()] == [(1, 1.0, 1.5)]
    p = spark.createDataFrame([(1, "W", 1.0, 1.9, 1.0), (1, "W", 5.0, 2.0, 1.0)], "c int, wall string, x double, y double, z double")
    got = rays.surface_coordinates(p, w, ["c"]).orderBy("x").collect()
    assert [(x.u, x.v, round(x.distance, 9), x.inside) for x in got] == [(1.0, 1.0, 0.1, True), (5.0, 1.0, 0.0, False)]


@pytest.mark.parametrize("whole_stage", ["true", "false"])
def test_walls_without_length_and_rays_along_a_wall(spark, whole_stage):
    """No plan may divide before it filters, with whole-stage code or without."""
    before = spark.conf.get("spark.sql.codegen.wholeStage")
    spark.conf.set("spark.sql.codegen.wholeStage", whole_stage)
    try:
        walls_ = [(1, "W", 0.0, 2.0, 4.0, 2.0, 0.0, -1.0, 0.0, 2.5), (1, "point", 1.0, 1.0, 1.0, 1.0, 0.0, -1.0, 0.0, 2.5)]
        w = spark.createDataFrame(walls_, "c int, wall string, sx double, sy double, ex double, ey double, nx double, ny double, z0 double, z1 double")
        r = spark.createDataFrame([(1, 1, 1.0, 2.0, 1.0, 3.0, 2.0, 2.0), (1, 2, 1.0, 0.0, 1.0, 1.0, 4.0, 2.0), (1, 3, 2.0, 2.0, 1.0, 2.0, 2.0, 2.0)], "c int, ray int, ox double, oy double, oz double, px double, py double, pz double")
        assert [(x.ray, x.wall, x.u, x.z) for x in rays.crossings(r, w, ["c"]).collect()] == [(2, "W", 1.0, 1.5)]
        p = spark.createDataFrame([(1, "point", 1.0, 1.0, 1.0), (1, "point", 1.0, 3.0, 1.0)], "c int, wall string, x double, y double, z double")
        assert [(x.u, x.v, x.distance, x.inside) for x in rays.surface_coordinates(p, w, ["c"]).orderBy("y").collect()] == [(0.0, 1.0, 0.0, True), (0.0, 1.0, -2.0, True)]
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", before)


def test_openings_of_walls_with_negative_bins_stay_apart(spark):
    """Bins left of a wall's start; parts of one wall never meet those of another."""
    cells = [(1, -1, 0), (1, -1, 1), (1, 0, 1), (0, 65535 - 32768 - 32768, 0), (0, 32767, 0), (0, 32767, 1), (0, 32766, 1), (2, -32768, -32768), (1, 5, -1), (1, 5, 0)]
    got = walls.opening_candidates(spark.createDataFrame(cells, "wall long, iu long, iz long"), "wall", least=1)
    assert sorted((r.wall, r.u0, r.u1, r.z0, r.z1, r.n) for r in got.collect()) == [(0, -1, 0, 0, 1, 1), (0, 32766, 32768, 0, 2, 3), (1, -1, 1, 0, 2, 3), (1, 5, 6, -1, 1, 2), (2, -32768, -32767, -32768, -32767, 1)]
    with pytest.raises(Exception, match="bins from"):
        walls.opening_candidates(spark.createDataFrame([(1, 40000, 0)], "wall long, iu long, iz long"), "wall").collect()
