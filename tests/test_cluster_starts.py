"""How many K-means starts run at once, and that it does not change the clusters."""

from keelson.operators import clusters as cl


def test_starts_at_once_are_bounded_by_rows():
    assert [cl.starts_at_once(n) for n in (0, 1000, 9_000_000, 15_000_000, 60_000_000)] == [4, 4, 4, 2, 1]


def test_clusters_do_not_depend_on_it(spark, monkeypatch):
    rows = [(i, *[float((i * (j + 3) * 7919) % 1009) for j in range(len(cl.CLUSTER_NUMERIC))]) for i in range(400)]
    df = spark.createDataFrame(rows, "Order_ID long, " + ", ".join(f"{c} double" for c in cl.CLUSTER_NUMERIC))
    together = sorted(map(tuple, cl.fit_clusters(df, n_init=3).collect()))
    monkeypatch.setattr(cl, "ROWS_IN_MEMORY", 1)
    assert sorted(map(tuple, cl.fit_clusters(df, n_init=3).collect())) == together
