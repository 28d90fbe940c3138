"""How filters interact: what each removes at each place of every order, and its Shapley share, by counting paths.

A document is its set of failed filters.  Filters applied so far are a state of the subset lattice; the edge from state S
to S with f removes the documents that fail f and nothing in S, whatever the order that led to S.  The number of orders
that reach S (forward) times the number that go on from S with f to the end (backward) is the number of orders through an
edge, so f's removals over all orders are the sum of its edges' removals, each times that number.  One order is a
path, so its steps are read from the same edges.  Documents are aggregated once, into a row per part and set of failed filters; everything
after works on these rows.

:func:`word_filters` holds the five filters of the query.  ``E`` (a copy of an earlier document) needs the smallest
doc_id of each text: minima are combined before the shuffle and written before they are joined back, so a text
that a third of all rows share is one row there, and Spark can split the join.

Defined cases: a null text counts as empty, a null part as the empty string; a null doc_id is neither smaller nor larger
than another, so such a row never fails E and no row fails because of it; rows that repeat a doc_id count each, and are no
copies of one another; a document is good (or toxic) if any label row of its doc_id says so, label rows
without a doc_id or without a value say nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import materialize, table

WS = r"\x20\x09-\x0D"
MIN_WORDS = 50
DISTINCT_PERCENT = 65
UPPER_PERCENT = 5
MARKS = "[#$%&*|]"
FILTERS = "ABCDE"
#: 7! orders of 7 steps are 35,280 rows a part
MAX_FILTERS = 7


def lattice(n: int) -> dict[tuple[int, int], int]:
    """Orders through each edge (state, filter) of the subset lattice of n filters: forward times backward counts."""
    full = (1 << n) - 1
    states = sorted(range(full + 1), key=int.bit_count)
    forward, backward = dict.fromkeys(states, 0), dict.fromkeys(states, 0)
    forward[0] = backward[full] = 1
    for s in states:
        for f in range(n):
            if not s >> f & 1:
                forward[s | 1 << f] += forward[s]
    for s in reversed(states):
        for f in range(n):
            if not s >> f & 1:
                backward[s] += backward[s | 1 << f]
    return {(s, f): forward[s] * backward[s | 1 << f] for s in states for f in range(n) if not s >> f & 1}


def audit(failures: DataFrame, filters: str) -> DataFrame:
    """One row per part, order of the filters and step.

    ``failures`` has part, fails (bit i: fails ``filters[i]``), documents, good and toxic (counts), a row per part and set.
    """
    n = len(filters)
    if not 0 < n <= MAX_FILTERS or len(set(filters)) != n:
        raise ValueError(f"filters must be 1 to {MAX_FILTERS} different letters")
    # at most 2^n sets a part
    sets = F.collect_list(F.struct("fails", "documents", "good", "toxic"))
    per_part = failures.groupBy("part").agg(sets.alias("sets"))

    def tally(condition, what: str = "documents") -> Column:
        return F.aggregate("sets", F.lit(0).cast("bigint"), lambda total, x: total + F.when(condition(x["fails"]), x[what]).otherwise(0))

    def each(count: int, condition, what: str = "documents") -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda at: tally(lambda fails: condition(fails, at), what))

    bit = F.array(*[F.lit(1 << f) for f in range(n)])
    through = lattice(n)

    def removes(fails: Column, at: Column) -> Column:
        """Whether edge ``at`` (state * n + filter) removes documents with these failures."""
        return (fails.bitwiseAND(F.floor(at / n).cast("int")) == 0) & (fails.bitwiseAND(F.get(bit, at % n)) != 0)

    per_part = per_part.select(
        "part", each(1 << n, lambda fails, s: fails.bitwiseAND(s) == 0).alias("passing"),
        each(n, lambda fails, f: fails.bitwiseAND(F.get(bit, f)) != 0).alias("failing"), each(n, lambda fails, f: fails == F.get(bit, f)).alias("only"),
        *[each(n * (1 << n), removes, what).alias(f"edge_{what}") for what in ("documents", "good", "toxic")])
    weights = [[through.get((s, f), 0) for s in range(1 << n)] for f in range(n)]
    edge = F.col("edge_documents")
    shapley = [sum((F.get(edge, F.lit(s * n + f)) * F.lit(w).cast("bigint") for s, w in enumerate(weights[f]) if w), F.lit(0).cast("bigint")) for f in range(n)]
    per_part = per_part.withColumn("shapley", F.array(*shapley))

    # the steps of every order: the state before it and the filter; the table is fixed by the filters
    steps = [("".join(filters[f] for f in order), i + 1, sum(1 << g for g in order[:i]), f) for order in permutations(range(n)) for i, f in enumerate(order)]
    path = json.dumps([dict(zip(("filter_order", "step", "state", "f"), s)) for s in steps])
    rows = per_part.select("*", F.inline(F.from_json(F.lit(path), "array<struct<filter_order:string,step:int,state:int,f:int>>")))
    removed = F.get("edge_documents", F.col("state") * n + F.col("f"))
    return rows.select(
        "part", "filter_order", "step",
        F.get("passing", F.col("state") + F.expr("shiftleft(1, f)")).alias("kept"),
        removed.alias("removed"), (F.get("failing", "f") - removed).alias("redundant"), F.get("only", "f").alias("unique_fails"),
        F.get("edge_good", F.col("state") * n + F.col("f")).alias("good_lost"), F.get("edge_toxic", F.col("state") * n + F.col("f")).alias("toxic_lost"),
        F.get("shapley", "f").alias("shapley"))


def word_filters(docs: DataFrame) -> DataFrame:
    """doc_id, part, text digest and ``fails`` without E, for every row of ``docs``: row-local."""
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "part", "text", F.filter(F.split("text", f"[{WS}]+"), lambda w: w != "").alias("words"))
    n = F.size("words")
    tests = [n < MIN_WORDS, 100 * F.size(F.array_distinct("words")) < DISTINCT_PERCENT * n,
             100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > UPPER_PERCENT * F.length("text"), F.col("text").rlike(MARKS)]
    bits = sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))
    return rows.select("doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), bits.cast("int").alias("fails"))


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (all five filters), documents, good, toxic: one row per part and set of failed filters."""
    rows = materialize(word_filters(docs), "audit-rows")
    firsts = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = materialize(firsts.where("first < last").select(F.col("digest").alias("copied"), "first"), "audit-firsts")
    truth = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    truth = materialize(truth, "audit-labels")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    found = rows.join(firsts, F.col("digest") == F.col("copied"), "left").join(truth, F.col("doc_id") == F.col("label_id"), "left")
    return found.groupBy("part", (F.col("fails") + F.when(copy, 1 << 4).otherwise(0)).alias("fails")).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.coalesce("good", F.lit(False))).alias("good"), F.count_if(F.coalesce("toxic", F.lit(False))).alias("toxic"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(failed_sets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), FILTERS)


def _sql() -> str:
    bits = ", ".join(f"({c})" for c in range(5))
    pairs = " AND ".join(f"p{a} <> p{b}" for a, b in combinations(range(5), 2))
    return rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     e AS (SELECT *, min(doc_id) OVER (PARTITION BY x) AS first FROM t),
     d AS (SELECT doc_id, part,
                  (len(ws) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(ws)) < {DISTINCT_PERCENT} * len(ws))::INT
                  + 4 * (100 * length(regexp_replace(x, '[^A-Z]+', '', 'g')) > {UPPER_PERCENT} * length(x))::INT
                  + 8 * regexp_matches(x, '{MARKS}')::INT + 16 * coalesce(doc_id > first, false)::INT AS fails FROM e),
     l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
     g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
           FROM d LEFT JOIN l USING (doc_id) GROUP BY part, fails),
     f AS (SELECT c FROM (VALUES {bits}) v(c)),
     o AS (SELECT a.c AS p0, b.c AS p1, c.c AS p2, d.c AS p3, e.c AS p4 FROM f a, f b, f c, f d, f e),
     s AS (SELECT substr('{FILTERS}', p0 + 1, 1) || substr('{FILTERS}', p1 + 1, 1) || substr('{FILTERS}', p2 + 1, 1) || substr('{FILTERS}', p3 + 1, 1)
                  || substr('{FILTERS}', p4 + 1, 1) AS filter_order, c + 1 AS step, [p0, p1, p2, p3, p4][c + 1] AS f,
                  CASE WHEN c > 0 THEN 1 << p0 ELSE 0 END + CASE WHEN c > 1 THEN 1 << p1 ELSE 0 END + CASE WHEN c > 2 THEN 1 << p2 ELSE 0 END
                  + CASE WHEN c > 3 THEN 1 << p3 ELSE 0 END AS state FROM o, f WHERE {pairs}),
     r AS (SELECT part, filter_order, step, f,
                  coalesce(sum(n) FILTER (WHERE fails & state = 0 AND fails & (1 << f) = 0), 0) AS kept,
                  coalesce(sum(n) FILTER (WHERE fails & state = 0 AND fails & (1 << f) <> 0), 0) AS removed,
                  coalesce(sum(n) FILTER (WHERE fails & state <> 0 AND fails & (1 << f) <> 0), 0) AS redundant,
                  coalesce(sum(n) FILTER (WHERE fails = 1 << f), 0) AS unique_fails,
                  coalesce(sum(good) FILTER (WHERE fails & state = 0 AND fails & (1 << f) <> 0), 0) AS good_lost,
                  coalesce(sum(toxic) FILTER (WHERE fails & state = 0 AND fails & (1 << f) <> 0), 0) AS toxic_lost
           FROM g, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""


SQL = _sql()
