"""Components: no table through the driver, no round more than needed."""

from plumbline.operators import graph


def test_joins_are_merged_and_stars_end(spark, monkeypatch):
    plans, write = [], graph.materialize

    def seen(df, name):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(graph, "materialize", seen)
    edges = spark.createDataFrame([(k, 1) for k in range(2, 30)] + [(41, 40), (7, 7)], "a long, b long")
    got = {tuple(r) for r in graph.components(edges).collect()}
    assert got == {(k, 1) for k in range(1, 30)} | {(40, 40), (41, 40)}
    assert len(plans) == 1
    assert not any("Broadcast" in p for p in plans)


def test_long_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100, 160)] + [(k, k + 3) for k in range(0, 60, 3)], "a long, b long")
    got = {tuple(r) for r in graph.components(edges).collect()}
    assert got == {(k, 100) for k in range(100, 161)} | {(k, 0) for k in range(0, 61, 3)}
