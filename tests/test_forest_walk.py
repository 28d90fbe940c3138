"""The forest's batch walk against a walk row by row through its node table; odd keys and values."""

import pytest
from keelson.operators import anomaly as an

COLS = ["a", "b"]
ROWS = [(i, float((i * 37) % 101), None if i % 11 == 0 else float((i * 7) % 13)) for i in range(300)]
ODD = [(1 << 60, 1.5, 2.5), ((1 << 60) + 1, 80.0, 12.0), (None, float("nan"), 3.0), (None, 4.0, None), (7, None, None), (7, 50.0, 6.0), (8, -0.0, 1e300)]


def _walk(node_rows, x):
    nodes = {(r.tree, r.node): r for r in node_rows}
    total = 0
    for tree in {t for t, _ in nodes}:
        node = nodes[tree, 1]
        while node.feature >= 0:
            v = x[node.feature]
            node = nodes[tree, 2 * node.node + (0 if v is not None and v <= node.threshold else 1)]
        total += node.length
    return total


@pytest.fixture(scope="module")
def forest(spark):
    return an.fit_forest(spark.createDataFrame(ROWS, "Order_ID long, a double, b double"), n_trees=10, psi=64, cols=COLS)


def test_batch_walk_equals_the_row_walk(spark, forest):
    node_rows = forest.nodes.collect()
    df = spark.createDataFrame(ROWS + ODD, "Order_ID long, a double, b double")
    got = sorted(an.path_scores(df, forest, ("Order_ID", "a"), COLS).select("Order_ID", "s").collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    walks = {}
    for key, *x in ROWS + ODD:
        walks.setdefault(key, []).append(_walk(node_rows, x))
    want = sorted(((key, 2.0 ** (-(sum(walks[key]) / (10 * len(walks[key]) * an.GRID)) / an.c_factor(64))) for key, *_ in ROWS + ODD),
                  key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [r[0] for r in got] == [k for k, _ in want]
    assert [r[1] for r in got] == pytest.approx([s for _, s in want], rel=1e-14)


def test_a_forest_of_no_rows_scores_none(spark):
    empty = spark.createDataFrame([], "Order_ID long, a double, b double")
    forest = an.fit_forest(empty, n_trees=4, psi=8, cols=COLS)
    df = spark.createDataFrame(ROWS, "Order_ID long, a double, b double")
    assert an.path_scores(df, forest, ("Order_ID",), COLS).count() == 0


def test_rows_are_not_multiplied_by_trees(spark, forest):
    df = spark.createDataFrame(ROWS, "Order_ID long, a double, b double")
    plan = an.path_scores(df, forest, ("Order_ID",), COLS)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
