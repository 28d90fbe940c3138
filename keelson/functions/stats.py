"""Exact, scale-safe order statistics.

``percentile`` keeps every distinct value of a group in one buffer, which does
not survive billions of distinct values.  Here an approximate sketch
(``percentile_approx``: bounded memory, rank error <= n/accuracy) first brackets
each wanted rank.  One pass then counts the rows below and above each bracket
and the rows of every distinct value inside it, combined before the shuffle, so
a value shared by most rows is one row.  While a bracket holds more than
``MAX_VALUES`` distinct values, a histogram of those value counts (not of the table)
narrows it.  The result equals linear interpolation over the whole column (numpy
``linear`` / DuckDB ``quantile_cont``: v_lo + frac * (v_hi - v_lo)).

The table is read twice whatever the number of quantiles and is never shuffled
by the group: the brackets are broadcast if they are few, measured by a count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 10_000
#: distinct values of one bracket that are ranked by one task
MAX_VALUES = 50_000
#: sub-ranges that a wide bracket is cut into
HISTOGRAM = 4096
#: brackets that are broadcast (one row per group and quantile); more are joined by a shuffle
BROADCAST_BRACKETS = 20_000


def exact_percentiles(df: DataFrame, col: str, qs: dict[str, float],
                      by: Sequence[str] = (), accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """One row per group of ``by`` with one column per name in ``qs`` (all over ``col``)."""
    return exact_quantiles(df, {name: (col, q) for name, q in qs.items()}, by=by, accuracy=accuracy)


def exact_quantiles(df: DataFrame, specs: dict[str, tuple[str, float]], by: Sequence[str] = (),
                    accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Exact linear-interpolated quantiles; ``specs`` maps output name -> (column, q).

    A spec may be (column, q, "rank") to get the ceil(q * n)-th smallest value instead
    (1-based order statistic, no interpolation).  Nulls are ignored; a group whose
    column has no non-null value gives null, and rows with a null group are left out.
    """
    from keelson.plans.materialize import materialize

    by, names = list(by), list(specs)
    wanted = [v if len(v) == 3 else (*v, "linear") for v in specs.values()]
    columns = list(dict.fromkeys(c for c, _, _ in wanted))
    base = df.select(*by, *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(columns)]).dropna(subset=by) if by else \
        df.select(*[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(columns)])
    eps = 2.0 / accuracy

    def sketch(i: int) -> list[Column]:
        c, q, _ = wanted[i]
        x = f"_x{columns.index(c)}"
        return [F.count(x).alias(f"_n{i}"), F.percentile_approx(x, [max(0.0, q - eps), min(1.0, q + eps)], accuracy).alias(f"_b{i}")]

    def bracket(i: int) -> Column:
        _, q, mode = wanted[i]
        n = F.col(f"_n{i}")
        pos = F.greatest(F.ceil(F.lit(q) * n) - 1, F.lit(0)).cast("double") if mode == "rank" else F.lit(q) * (n - 1)
        return F.struct(F.lit(i).alias("_i"), n.alias("_n"), F.floor(pos).cast("bigint").alias("_klo"), F.ceil(pos).cast("bigint").alias("_khi"),
                        (pos - F.floor(pos)).alias("_fr"), F.col(f"_b{i}")[0].alias("_lo"), F.col(f"_b{i}")[1].alias("_hi"))

    stats = base.groupBy(*by).agg(*[c for i in range(len(names)) for c in sketch(i)])
    brackets = stats.select(*by, F.explode(F.array(*[bracket(i) for i in range(len(names))])).alias("_s")).select(*by, "_s.*")
    brackets = materialize(brackets, "quantile-brackets")
    known = F.broadcast(brackets) if brackets.count() <= BROADCAST_BRACKETS else brackets
    values = base.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"_x{columns.index(c)}").alias("_x"))
                                                  for i, (c, _, _) in enumerate(wanted)])).alias("_e")).select(*by, "_e.*").where("_x IS NOT NULL")
    key = [*by, "_i"]
    x, lo, hi = F.col("_x"), F.col("_lo"), F.col("_hi")
    side = F.when(x < lo, F.lit(-1)).when(x > hi, F.lit(1)).otherwise(F.lit(0))
    cells = (values.join(known, key).withColumn("_side", side).groupBy(*key, "_side", F.when(F.col("_side") == 0, x).alias("_v"))
             .agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most")))
    # below a bracket only its largest value can be wanted, above it only its least
    cells = materialize(cells.select(*key, "_side", "_c", F.when(F.col("_side") < 0, F.col("_most")).otherwise(F.col("_least")).alias("_v")),
                        "quantile-cells")
    while True:
        most = cells.where("_side = 0").groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= MAX_VALUES:
            break
        cells = materialize(_narrow(cells, brackets, key), "quantile-cells")
    order = Window.partitionBy(*key).orderBy("_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.withColumn("_end", F.sum("_c").over(order)).join(brackets.drop("_lo", "_hi"), key)

    def at(k: str) -> Column:
        return F.max(F.when((F.col(k) < F.col("_end")) & (F.col(k) >= F.col("_end") - F.col("_c")), F.col("_v")))
    picked = ranked.groupBy(*key).agg(at("_klo").alias("_vlo"), at("_khi").alias("_vhi"), F.first("_fr").alias("_fr"))
    value = F.col("_vlo") + F.col("_fr") * (F.col("_vhi") - F.col("_vlo"))
    found = brackets.select(*key).join(picked, key, "left")
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, value)).alias(name) for i, name in enumerate(names)])


def _narrow(cells: DataFrame, brackets: DataFrame, key: list[str]) -> DataFrame:
    """The cells, with all but the sub-ranges of each bracket that hold its wanted ranks joined to its sides."""
    inside = F.col("_side") == 0
    ends = cells.where(inside).groupBy(*key).agg(F.min("_v").alias("_a"), F.max("_v").alias("_z"))
    step = F.when(F.col("_z") > F.col("_a"), (F.col("_z") - F.col("_a")) / HISTOGRAM)  # null: a single value
    cut = F.when(F.col("_side") != 0, F.when(F.col("_side") < 0, F.lit(-1)).otherwise(F.lit(HISTOGRAM))).otherwise(
        F.least(F.floor((F.col("_v") - F.col("_a")) / step), F.lit(HISTOGRAM - 1))).cast("int")
    cells = cells.join(ends, key, "left").withColumn("_cut", F.coalesce(cut, F.lit(0))).drop("_a", "_z")
    sums = cells.groupBy(*key, "_cut").agg(F.sum("_c").alias("_s"))
    upto = Window.partitionBy(*key).orderBy("_cut").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_end", F.sum("_s").over(upto)).join(brackets.select(*key, "_klo", "_khi"), key)
    side = F.when(F.col("_end") <= F.col("_klo"), F.lit(-1)).when(F.col("_end") - F.col("_s") > F.col("_khi"), F.lit(1)).otherwise(F.lit(0))
    cells = cells.join(sums.select(*key, "_cut", side.alias("_to")), [*key, "_cut"])
    value = F.when(F.col("_to") == 0, F.col("_v"))
    return (cells.groupBy(*key, F.col("_to").alias("_side"), value.alias("_k")).agg(F.sum("_c").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
            .select(*key, "_side", "_c", F.when(F.col("_side") < 0, F.col("_most")).otherwise(F.col("_least")).alias("_v")))
