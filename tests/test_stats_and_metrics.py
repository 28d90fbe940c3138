"""Exact quantiles against numpy; AUC/AP against brute force; split invariants."""

import random

import numpy as np

from keelson.functions.stats import exact_quantiles
from keelson.operators import ml


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(7)
    for n in (1, 2, 7, 50, 3000):
        vals = [float(rnd.randint(0, 20)) for _ in range(n)]
        df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(vals)], "x double, g int")
        qs = {"a": ("x", 0.99), "b": ("x", 0.5), "c": ("x", 0.25), "d": ("x", 0.95)}
        r = exact_quantiles(df, qs, accuracy=500).collect()[0]
        for k, (_, q) in qs.items():
            assert abs(r[k] - float(np.quantile(vals, q))) < 1e-12
        for row in exact_quantiles(df, qs, by=["g"], accuracy=500).collect():
            sub = [v for i, v in enumerate(vals) if i % 2 == row["g"]]
            for k, (_, q) in qs.items():
                assert abs(row[k] - float(np.quantile(sub, q))) < 1e-12


def _brute_auc(s, y):
    pos = [a for a, b in zip(s, y) if b == 1]
    neg = [a for a, b in zip(s, y) if b == 0]
    tot = sum((1.0 if p > q else 0.5 if p == q else 0.0) for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def _brute_ap(s, y):
    order = sorted(set(s), reverse=True)
    P = sum(y)
    ap, prev_r = 0.0, 0.0
    for t in order:
        tp = sum(1 for a, b in zip(s, y) if a >= t and b == 1)
        fp = sum(1 for a, b in zip(s, y) if a >= t and b == 0)
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


def test_auc_and_ap_brute_force(spark):
    rnd = random.Random(3)
    s = [round(rnd.random(), 2) for _ in range(400)]
    y = [1 if rnd.random() < v else 0 for v in s]
    df = spark.createDataFrame(list(zip(s, y)), "p double, Is_Delayed int")
    m = ml.evaluate(df, "p").collect()[0]
    assert abs(m.roc_auc - _brute_auc(s, y)) < 1e-12
    assert abs(m.average_precision - _brute_ap(s, y)) < 1e-12


def test_split_disjoint_and_stratified(spark):
    from table_dirs import SMALL
    from keelson.plans import scored as sc
    import math
    f = ml.with_split(sc.featured(spark, SMALL))
    rows = f.groupBy("Is_Delayed", "is_test").count().collect()
    by = {(r.Is_Delayed, r.is_test): r["count"] for r in rows}
    for lab in (0, 1):
        n = by[(lab, True)] + by[(lab, False)]
        assert by[(lab, True)] == math.ceil(0.2 * n)       # exact per-class test size
    assert sum(by.values()) == f.count()                   # exhaustive and disjoint


def test_rank_mode_order_statistic(spark):
    import math
    rnd = random.Random(5)
    for n in (1, 4, 37, 2500):
        vals = [rnd.random() for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in vals], "x double")
        got = exact_quantiles(df, {"k": ("x", 0.2, "rank")}, accuracy=300).collect()[0].k
        assert got == sorted(vals)[max(math.ceil(0.2 * n) - 1, 0)]


def test_quantiles_of_tied_values_keep_the_ranked_table_small(spark, monkeypatch):
    from keelson.plans import materialize as mt
    sizes = {}
    real = mt.materialize

    def spy(df, name):
        out = real(df, name)
        sizes[name] = out.count()
        return out
    monkeypatch.setattr(mt, "materialize", spy)
    for n in (2000, 20000):
        df = spark.range(n).selectExpr("CASE WHEN id % 10 < 3 THEN 7.0D ELSE id * 1.0D END AS x", "id % 4 AS g")
        vals = np.where(np.arange(n) % 10 < 3, 7.0, np.arange(n))
        got = exact_quantiles(df, {"a": ("x", 0.2), "b": ("x", 0.99)}).first()
        assert (got.a, got.b) == (np.quantile(vals, 0.2), np.quantile(vals, 0.99))
        assert sizes["quantile-cells"] <= 2 * (2 + 4 * n / 10_000 + 3)


def test_wide_brackets_are_narrowed(spark, monkeypatch):
    from keelson.functions import stats
    monkeypatch.setattr(stats, "MAX_VALUES", 5)
    monkeypatch.setattr(stats, "HISTOGRAM", 4)
    rnd = random.Random(11)
    vals = [rnd.choice([rnd.gauss(0, 1), rnd.gauss(0, 1e6), 3.0]) for _ in range(4000)]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(vals)], "x double, g int")
    for row in exact_quantiles(df, {"a": ("x", 0.37), "b": ("x", 0.9), "k": ("x", 0.2, "rank")}, by=["g"], accuracy=50).collect():
        sub = sorted(v for i, v in enumerate(vals) if i % 3 == row["g"])
        assert abs(row.a - np.quantile(sub, 0.37)) < 1e-9 * max(1, abs(row.a)) and abs(row.b - np.quantile(sub, 0.9)) < 1e-9 * max(1, abs(row.b))
        assert row.k == sub[-(-len(sub) // 5) - 1]


def test_split_does_not_shuffle_by_label(spark):
    df = spark.range(500).selectExpr("id AS Order_ID", "CAST(id % 7 = 0 AS INT) AS Is_Delayed")
    plan = ml.with_split(df)._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Range (0, 500" in line)
    depth, above = len(plan[at]) - len(plan[at].lstrip(" :+-")), []
    for line in reversed(plan[:at]):   # the nodes above the table's scan
        d = len(line) - len(line.lstrip(" :+-"))
        if d < depth:
            depth = d
            above.append(line)
    assert above and not any("Exchange" in line for line in above)
