import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from plumbline.plans import scope
from plumbline.plans.result import drop_dangling, measure, null_dangling, unique_ids
from plumbline.plans.rules import RULES, evaluate

M = "struct<value: double, lo: double, hi: double>"


@pytest.fixture(scope="module")
def room(spark):
    rooms = spark.createDataFrame([(1, "R1", 0, 0.0, 2.5, (12.0, 11.0, 13.0))], f"capture_id int, room_id string, room_ord int, floor_z double, ceiling_z double, floor_area {M}")
    ends = [(0, 0, 4, 0), (4, 0, 4, 3), (4, 3, 0, 3), (0, 3, 0, 0)]
    walls = spark.createDataFrame(
        [(1, "R1", f"R1-W{k}", k, *map(float, e), (float(abs(e[0] - e[2]) + abs(e[1] - e[3])), None, None), (2.5, 2.4, 2.6)) for k, e in enumerate(ends)],
        f"capture_id int, room_id string, wall_id string, k int, sx double, sy double, ex double, ey double, length {M}, height {M}",
    )
    openings = spark.createDataFrame([(1, "R1", "R1-W0", "O1", "door", 1.0, 0.9, 2.0, None), (1, "R1", "R1-W1", "O2", "window", 1.0, 1.0, 1.0, 0.9)], "capture_id int, room_id string, wall_id string, opening_id string, type string, offset double, width double, height double, sill double")
    objects = spark.createDataFrame([(1, "X1", "sink", 0.5, 0.4, None, None, None, None, 0.0, 0.9)], "capture_id int, object_id string, cls string, x double, y double, x0 double, y0 double, x1 double, y1 double, z0 double, z1 double")
    return rooms, walls, openings, objects


def region(spark, rows):
    full = [(1, d, i, "R1", s, c, a, w, h, n, u0, u0 + w, v0, v0 + h) for i, (d, s, c, a, w, h, n, u0, v0) in enumerate(rows)]
    return spark.createDataFrame(full, "capture_id int, damage_id string, ord int, room_id string, surface_id string, cls string, area double, width double, height double, length double, u0 double, u1 double, v0 double, v1 double")


def flags(spark, room, rows):
    rooms, walls, openings, objects = room
    return [(r.flag_id, r.rule_id, r.damage_ids) for r in evaluate(region(spark, rows), rooms, walls, openings, objects).orderBy("flag_id").collect()]


def test_stain_at_the_floor_near_a_sink(spark, room):
    got = flags(spark, room, [("D1", "R1-W0", "water_stain", 0.2, 0.5, 0.4, None, 0.2, 0.05)])
    assert [g[1] for g in got] == ["R-WALL-WICK", "R-FIXTURE-LEAK"]


def test_a_high_stain_far_from_all_is_quiet(spark, room):
    assert flags(spark, room, [("D1", "R1-W2", "water_stain", 0.2, 0.3, 0.3, None, 3.0, 1.8)]) == []


def test_window_leak(spark, room):
    assert [g[1] for g in flags(spark, room, [("D1", "R1-W1", "water_stain", 0.1, 0.3, 0.3, None, 1.2, 0.3)])] == ["R-WINDOW-LEAK"]


def test_crack_from_a_door_corner_and_long(spark, room):
    got = flags(spark, room, [("D1", "R1-W0", "crack", 0.01, 0.8, 0.8, 1.13, 1.95, 2.05)])
    assert [g[1] for g in got] == ["R-CRACK-OPENING", "R-CRACK-LONG"]


def test_mold_adds_up_over_the_room(spark, room):
    rows = [("D1", "R1-W0", "mold", 0.6, 1.0, 0.6, None, 2.0, 0.5), ("D2", "R1-CEIL", "mold", 0.6, 1.0, 0.6, None, 1.0, 1.0)]
    got = flags(spark, room, rows)
    assert ("F1", "R-MOLD-LIMITED", ["D1", "D2"]) in got and sum(g[1] == "R-MOLD-HIDDEN" for g in got) == 2


def test_unknown_condition_raises(spark, room):
    with pytest.raises(ValueError, match="unknown conditions"):
        evaluate(region(spark, []), *room, rules=({"id": "R", "when": {"moon": 1}, "per": "region", "severity": "low"}, *RULES))


def test_line_items(spark, room):
    rooms, walls, openings, objects = room
    damage = region(spark, [("D1", "R1-W0", "water_stain", 0.4, 1.0, 0.4, None, 2.5, 0.0), ("D2", "R1-W0", "water_stain", 0.4, 1.0, 0.4, None, 3.0, 0.0)])
    found = evaluate(damage, rooms, walls, openings, objects)
    m = lambda c: F.struct(F.col(c).alias("value"), (F.col(c) * 0.9).alias("lo"), (F.col(c) * 1.1).alias("hi"))
    damage = damage.withColumns({c: m(c) for c in ("area", "width", "height", "length")})
    openings = openings.withColumns({c: m(c) for c in ("width", "height")})
    items = {r.entry: r for r in scope.line_items(damage, found, rooms, walls, openings).collect()}
    # boxes 1.3 x 0.7 m, 0.5 m apart, cut at the wall's end and the floor
    assert items["STAIN-SEAL"].value == pytest.approx((4.0 - 2.35) * (0.4 + 0.15) * 10.7639)
    assert items["REPAINT"].value == pytest.approx((4 * 2.5 - 0.9 * 2.0) * 10.7639)
    assert items["REPAINT"].lo == pytest.approx((4 * 2.4 - 0.99 * 2.2) * 10.7639)
    assert items["WICK-FLOOD-CUT"].value == pytest.approx((4.0 - 1.9) * 3.28084)
    assert items["WICK-INSULATION"].value == pytest.approx((4.0 - 1.9) * 0.6 * 10.7639)
    assert all(i.lo <= i.value <= i.hi for i in items.values())


def test_repairs(spark):
    df = spark.createDataFrame([(1, "A", 1, "X"), (1, "A", 2, "B"), (1, "B", 3, None)], "c int, id string, o int, ref string")
    assert [r.id for r in unique_ids(df, ["c"], "id", ["o"]).orderBy("o").collect()] == ["A", "A~2", "B"]
    assert [r.o for r in drop_dangling(df, "ref", df, "id", ["c"]).collect()] == [2]
    assert [r.ref for r in null_dangling(df, "ref", df, "id", ["c"]).orderBy("o").collect()] == [None, "B", None]
    m = spark.range(1).select(measure(F.lit(2.0), F.lit(None).cast("double"), F.lit(1.5), "m").alias("m")).first().m
    assert (m.value, m.lo, m.hi) == (2.0, 2.0, 2.0)


def test_regions_of_a_flag_do_not_carry_its_list(spark, sf_dir, monkeypatch):
    """A flag of n regions would be n lists of n ids, and its regions, small as a file, would go through the driver."""
    from plumbline.queries import QUERIES

    written, write = [], DataFrameWriter.parquet

    def kept(self, path, *args, **more):
        written.append((path.rpartition("/")[2], self._df.columns, self._df._jdf.queryExecution().sparkPlan().toString()))
        return write(self, path, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", kept)
    assert QUERIES["line_items_all"](spark, sf_dir).where("n_flags > 0 AND n_damage > 1").count() > 0
    hits = [(columns, plan) for path, columns, plan in written if path.startswith("hits-")]
    assert len(hits) == 17 and not any("damage_ids" in columns for columns, _ in hits)
    guessed = [plan for path, _, plan in written if path.startswith(("hits-", "regions-", "segments-")) and "Broadcast" in plan]
    assert not guessed
