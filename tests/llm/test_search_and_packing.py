"""op2, op3, op4, op10 and the pipeline against brute force."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keelson.llm import chat, decontam, knn_join, packing, queries
from keelson.llm.common import materialize

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_warc_chunk_table", "op2_snapshot_collapse", "op6_recompression_dedup", "op10_voronoi_knn", "op12_filter_audit"])
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SMALL)
    want = con.sql(queries.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key) == sorted(want.select(*cols).fetchall(), key=key)


def test_snapshot_collapse(spark):
    rows = []

    def log(conv, turns):
        rows.extend((conv, i, r, t) for i, (r, t) in enumerate(turns))
    full = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    log(1, full[:2]), log(2, full), log(3, full), log(4, full[:3]), log(5, [("user", "a"), ("assistant", "x")]), log(None, full[:1])
    rows += [(6, None, None, None), (6, 0, "user", None), (6, 0, "user", None), (7, 0, "user", ""), (8, 5, "user", "gap"), (8, 900, "user", "gap2")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("clash")).withColumn("h0", F.lit(1))
    got = chat.format_maximal(df).collect()
    kept = {}
    for r in got:
        kept.setdefault(r.conv_id, []).append(r)
    assert set(kept) == {2, 5, 6, 7, 8}
    assert [r.rendered for r in sorted(kept[2], key=lambda r: r.pos)] == [f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in full]
    for turns in kept.values():
        at = 0
        for k, r in enumerate(sorted(turns, key=lambda r: r.pos)):
            assert (r.pos, r.n_turns, r.char_start) == (k, len(turns), at)
            at += len(r.rendered)
    assert chat.format_maximal(df.limit(0)).count() == 0


def test_decontamination_equals_all_pairs(spark, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    items += [(None, "One two three. Four five six seven eight nine."), (900, None), (901, ""), (902, "a b"), (900, "Alpha beta gamma delta epsilon zeta eta theta.")]
    filler = " ".join(f"f{i}" for i in range(70_000))
    # a copy with another word in its last sentence, which is too short to hold a shingle without that word
    items += [(903, " ".join(f"q{k}" for k in range(30)) + ". The answer is rather seven.")]
    edited = " ".join(f"q{k}" for k in range(30)) + ". The answer is surely seven."
    docs += [(5000, None), (5001, ""), (5002, filler + " one TWO three, four five six seven eight nine " + filler), (None, "alpha beta gamma delta epsilon zeta eta theta"),
             (5004, "so " + edited + " it goes"), (5003, "one two three " + filler[:3000] + " four five six seven eight nine"), (5002, "again: Alpha beta gamma delta epsilon zeta eta")]
    split = [(i, *decontam.question_answer(t)) for i, t in items]
    want = set()
    for d, t in docs:
        ws = decontam.words(t)
        for i, q, a in split:
            if len(q) + len(a) < decontam.MIN_WORDS:
                continue
            longest = max(decontam.MIN_STRIDE, *(len(x) + len(y) for _, x, y in split))
            for at in range(0, max(1, len(ws)), longest):
                part = ws[at:at + 2 * longest]
                have = decontam.shingles(part)
                covered = [decontam._covered(decontam.shingles(x), have, part) for x in (q, a, q + a)]
                if min(covered[:2]) >= decontam.OVERLAP or covered[2] >= decontam.OVERLAP:
                    want.add((d, i))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = decontam.contaminated_pairs(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) and {(5002, None), (None, 900), (5004, 903)} <= want
    # in shards: nothing is lost (a shard with shorter items cuts shorter passages, which hold them whole)
    sharded = {(r.doc_id, r.item_id) for r in decontam.contaminated_pairs(df, bench, shard_items=9).collect()}
    assert {p for p in want if p[0] is None or p[0] < 5000} <= sharded
    clean = decontam.decontaminate(df, bench)
    assert clean.columns == df.columns
    bad = {d for d, _ in want}
    # rows are judged by their own text: the other row of 5002 holds three of four shingles and stays
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - (bad - {5002})
    assert [r.text[:6] for r in clean.where("doc_id = 5002").collect()] == ["again:"]
    assert decontam.contaminated_pairs(df, bench.limit(0)).count() == 0 and decontam.contaminated_pairs(df.limit(0), bench).count() == 0


def test_decontamination_does_not_depend_on_the_shards(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    items += [(900, " ".join(f"i{k}" for k in range(150))), (901, "Alpha beta gamma delta epsilon. Zeta eta theta iota kappa."), (902, None), (None, "a b")]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    # question and answer lie further apart than an item of usual length, but within one of 150 words
    docs += [(5000, "alpha beta gamma delta epsilon " + " ".join(f"f{k}" for k in range(130)) + " zeta eta theta iota kappa")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, *others = [sorted(map(tuple, decontam.contaminated_pairs(df, bench, shard_items=n).collect()), key=str) for n in (10**6, 9, 2)]
    assert (5000, 901) in {(r[0], r[2]) for r in one}
    assert all(o == one for o in others)


def test_copies_of_items_longer_than_a_text_block_are_found():
    long = [f"i{k}" for k in range(decontam.TEXT_BLOCK + 700)]
    short = "alpha beta gamma delta epsilon zeta eta theta".split()
    index = decontam.Index([(1, " ".join(long)), (2, " ".join(short))])
    stride = len(long)
    assert index.stride == stride
    filler = [f"f{k}" for k in range(4 * stride)]
    for at in (stride // 2, stride + 37, 3 * stride - 5):  # each copy crosses a multiple of the stride
        assert 0 in index.matches(" ".join(filler[:at] + long + filler[at:])), at
    for at in (stride - 4, 2 * stride - 3, 3 * stride - 4):
        assert 1 in index.matches(" ".join(filler[:at] + short + filler[at:])), at


def test_best_fit_takes_the_tightest_compatible_bin(spark):
    rng = random.Random(5)
    for trial in range(30):
        n = 60
        sizes = [rng.randint(0, 100) for _ in range(n)]
        sources = [rng.choice(["hot", "hot", "a", "b", None]) for _ in range(n)]
        clusters = [rng.choice(["x", "y", None, f"own{i}"]) for i in range(n)]
        bins, offsets = packing.best_fit(sizes, sources, clusters, 100)
        held = []
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            ok = [(100 - sum(sizes[j] for j in b), k) for k, b in enumerate(held)
                  if sum(sizes[j] for j in b) + sizes[i] <= 100 and not any(
                      (sources[i] is not None and sources[i] == sources[j]) or (clusters[i] is not None and clusters[i] == clusters[j]) for j in b)]
            if not ok:
                held.append([])
            k = min(ok)[1] if ok else len(held) - 1
            assert bins[i] == k and offsets[i] == sum(sizes[j] for j in held[k])
            held[k].append(i)


def test_packing(spark):
    rows = [(i, "w " * (i * 7 % 50), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(300)]
    rows += [(1000, "long " * 1234, "hot"), (1001, None, None), (1002, "", None), (1003, "Same  text", "a"), (1004, "same text", "b"), (1004, "same text", "b"), (None, "x y", "c"),
             (1005, "z " * 40, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("bin", F.lit("clash")).withColumn("rid", F.lit(1))
    got = packing.pack(materialize(packing.lengths(df), "t"), capacity=40, block_rows=100).toPandas()
    assert got.groupby("bin_id").n_words.sum().max() <= 40
    assert not got[got.source.notna()].duplicated(["bin_id", "source"]).any() and not got[got.cluster.notna()].duplicated(["bin_id", "cluster"]).any()
    order = got.sort_values(["bin_id", "bin_offset", "n_words"])
    assert (order.groupby("bin_id").n_words.cumsum() - order.n_words == order.bin_offset).all()
    assert got.n_words.sum() == sum(len((t or "").split()) for _, t, _ in rows)
    long = got[got.doc_id == 1000].sort_values("piece")
    assert long.piece.tolist() == list(range(31)) and (long.first_word == long.piece * 40).all()
    assert len(got[got.doc_id == 1004]) == 2 and len(got[got.doc_id == 1002]) == 1
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_near_copies_never_share_a_bin(spark):
    rng = random.Random(7)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    base = [f"b{k}" for k in range(120)]
    for i in range(40):  # a group of copies of one text, each with one word edited
        ws = list(base)
        ws[rng.randrange(120)] = f"e{i}"
        docs.append((9000 + i, " ".join(ws)))
    one = "the quick brown fox jumps over a lazy dog while nine grey cats look on from two high walls and say nothing at all".split()
    docs += [(9100, " ".join(one)), (9101, " ".join([*one[:-1], "ALL."])), (9102, "one two"), (9103, "One  two"), (9104, "one three"), (9105, ""), (None, " ".join(one))]
    docs = [(d, t, f"s{i}") for i, (d, t) in enumerate(docs)]
    got = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string, source string"), capacity=4096).collect()
    cluster = {(r.source): r.cluster for r in got}
    sets = []
    for _, t, s in docs:
        ws = (t or "").lower().split()
        sets.append((s, {tuple(ws[k:k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()))
    near = [(s, t) for k, (s, a) in enumerate(sets) for t, b in sets[:k] if a and 5 * len(a & b) >= 4 * len(a | b)]
    assert len(near) > 100 and all(cluster[s] == cluster[t] for s, t in near)
    at = {d: cluster[s] for d, _, s in docs}
    assert at[9100] == at[9101] == at[None] and at[9102] == at[9103] != at[9104] and at[9105] is None
    held = [(r.bin_id, r.cluster) for r in got if r.cluster is not None]
    assert len(held) == len(set(held))


@pytest.mark.parametrize("seed", range(4))
def test_scoring_by_blocks_equals_scoring_all_postings(seed):
    """The postings of live blocks give the scores that all postings give; every item at its threshold is a candidate."""
    import numpy as np
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 30)))) for i in range(90)]
    index = decontam.Index(items)
    ws = [w for i in rng.sample(range(90), 12) for w in items[i][1].split() + rng.choices(vocabulary, k=20)]
    ids = np.array([index.terms.get(w, -1) for w in ws])
    at = np.flatnonzero(ids >= 0)
    passages = -(-len(ws) // index.stride)
    got = {(p, i): s for p, i, s in index.candidates(ids[at], at, passages)}
    want = {}
    for p in range(passages):
        terms = set(ids[p * index.stride:(p + 2) * index.stride]) - {-1}
        scores = np.zeros(len(items))
        for t in sorted(terms):
            part = slice(index.starts[t, 0], index.starts[t, -1])
            scores[index.items[part]] += index.impacts[part]
        want |= {(p, int(i)): float(scores[i]) for i in np.flatnonzero(scores >= index.thresholds)}
    assert got == want and want


def test_top_k(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(300)]  # one very common vector
    rows += [(900, None), (950, [0.5, None]), (901, [float("nan")] * 8), (902, [float("inf")] * 8), (903, [0.25]), (904, []), (50, rows[50][1]), (1000, [1.0] * 9)]
    rows += [(None, [0.9] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("clash"))
    vectors = df.select("vec_id", "cell", knn_join.integer_vector(F.col("embedding")).alias("v"))
    got = knn_join.voronoi_top_k(vectors, queries_per_pivot=4, rows_per_task=64).collect()
    import math
    ints = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for i, v in ints:
        if i is not None and i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j) for j, w in ints if j != i)[:5]
            want += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(best)]
    key = lambda r: (r[0], r[1])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert knn_join.voronoi_top_k(vectors.limit(0)).count() == 0
    one = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<double>")
    assert knn_join.voronoi_top_k(one.select("vec_id", knn_join.integer_vector(F.col("embedding")).alias("v"))).count() == 0


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first().text
    base = docs.orderBy("doc_id").first()
    more = spark.createDataFrame(
        [(9001, "12345 67890 !!", "en", "x", 1), (9002, base.text, "en", "x", 1), (9003, "Some words before. " + item, "en", "x", 1), (9004, None, None, None, None)],
        docs.schema)
    first = docs.unionAll(more).withColumn("fp", F.lit("clash"))
    got, frames = first, {}
    for name, stage in corpus_pipeline.STAGES:
        got = frames[name] = materialize(stage(spark, got, SMALL), name)
        if name != "packing":
            assert got.columns == first.columns
    ids = {n: {r.doc_id for r in f.select("doc_id").collect()} for n, f in frames.items()}
    assert not ids["language_id"] & {9001, 9004} and len(ids["language_id"]) >= docs.count()
    assert 9002 not in ids["near_dedup"] and base.doc_id in ids["near_dedup"]
    assert 9003 in ids["near_dedup"] and 9003 not in ids["decontamination"]
    assert frames["pii"].where(F.col("text").rlike(r"[a-z0-9]@[a-z0-9]+\.example")).count() == 0 and ids["pii"] == ids["decontamination"] == ids["packing"]
    assert frames["pii"].where(F.col("text").contains("[EMAIL]")).count() > 0
