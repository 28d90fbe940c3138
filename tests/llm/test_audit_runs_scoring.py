"""op11, op12 and op13 against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import filter_audit, logbilinear, runs

SMALL = "/root/testdata/sf0.01"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def naive_audit(rows, labels):
    """Steps of every order by applying the filters one after the other."""
    docs = []
    for i, text, source in rows:
        t, ws = text or "", words_of(text)
        fails = [len(ws) < 50, 100 * len(set(ws)) < 65 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)),
                 i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)]
        good = any(q == 1 for j, q, _ in labels if j is not None and j == i)
        toxic = any(x == 1 for j, _, x in labels if j is not None and j == i)
        docs.append((source or "", fails, good, toxic))
    out = {}
    for part in {d[0] for d in docs}:
        shapley = Counter()
        for order in itertools.permutations(range(5)):
            left = [d for d in docs if d[0] == part]
            everyone = left
            for step, f in enumerate(order):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shapley[f] += len(gone)
                out[part, "".join("ABCDE"[g] for g in order), step + 1] = [
                    len(left), len(gone), sum(d[1][f] for d in everyone) - len(gone), sum(d[1][f] and sum(d[1]) == 1 for d in everyone),
                    sum(d[2] for d in gone), sum(d[3] for d in gone), f]
        for (p, *_), row in out.items():
            if p == part:
                row[6] = shapley[row[6]]
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark):
    rng = random.Random(12)
    vocabulary = ["alpha", "Beta", "GAMMA", "x|y", "delta", "$5"] + [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        pool = vocabulary if i % 4 == 0 else vocabulary[6:] if i % 4 == 1 else vocabulary[:3] if i % 4 == 2 else vocabulary[4:40]
        rows.append((i, " ".join(rng.choice(pool) for _ in range(rng.choice([0, 3, 49, 50, 60, 90]))), rng.choice(["web", "news", None, ""])))
    rows += [(200 + i, rows[i][1], "web") for i in range(0, 60, 3)]
    rows += [(300, None, "web"), (301, "", None), (302, " \t\n", "news"), (3, "other text of the same id", "web"), (3, rows[3][1], "web"), (None, rows[4][1], "web"),
             (None, rows[4][1], "news"), (400, "long " * 60_000, "long"), (401, "É é 😀 " * 30, "web")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 320, 2)] + [(4, 1, 1), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("part", F.lit("clash")).withColumn("fails", F.lit(3)).withColumn("digest", F.lit(""))
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("clash"))
    got = filter_audit.audit(filter_audit.failed_sets(docs, truth), "ABCDE").collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == naive_audit(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})
    assert filter_audit.audit(filter_audit.failed_sets(docs.limit(0), truth), "ABCDE").count() == 0
    unlabelled = filter_audit.audit(filter_audit.failed_sets(docs, truth.limit(0)), "ABCDE")
    assert unlabelled.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


@pytest.mark.parametrize("n", [1, 3, 5, 7])
def test_lattice_counts_every_order_once(n):
    through = filter_audit.lattice(n)
    paths = Counter()
    for order in itertools.permutations(range(n)):
        for i, f in enumerate(order):
            paths[sum(1 << g for g in order[:i]), f] += 1
    assert through == dict(paths)
    assert sum(w for (s, _), w in through.items() if s == 0) == math.factorial(n)


def test_audit_of_other_filters(spark):
    failures = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 2, 1, 1), ("p", 3, 4, 0, 2)], "part string, fails int, documents long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.audit(failures, "XY").collect()}
    assert got == {("XY", 1): (5, 6, 0, 2, 8), ("XY", 2): (5, 0, 4, 0, 4), ("YX", 1): (7, 4, 0, 0, 4), ("YX", 2): (5, 2, 4, 2, 8)}
    with pytest.raises(ValueError):
        filter_audit.audit(failures, "ABCDEFGH")


def naive_runs(ws, least=12):
    """All maximal stretches by comparing every pair of places."""
    out, n = {}, len(ws)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def periodic_texts(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(120):
        letters = [f"w{i}" for i in range(rng.choice([1, 2, 3, 8, 60]))]
        ws = [rng.choice(letters) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.choice(letters + ["x", "y"]) for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 17, 20, 33]))]
            at = rng.randint(0, len(ws))
            repeated = unit * rng.randint(2, 9)
            ws[at:at] = repeated[:rng.randint(len(unit), len(repeated))]
        out.append(ws)
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    morse = [str(i.bit_count() % 2) for i in range(600)]
    out += [list(fib[-1]), morse, [], ["a"] * 11, ["a"] * 12, ["a"] * 700, ["a", "b"] * 6, list("abcabcabcab"), list("abcdef" * 2), list("aabaabaabaabcaabaabaabaab")]
    return out


@pytest.mark.parametrize("least,small,places", [(12, 16, 1 << 20), (12, 2, 50), (2, 1, 7), (40, 4, 1000)])
def test_runs_equal_all_pairs(monkeypatch, least, small, places):
    monkeypatch.setattr(runs, "SMALL_LAG", small)
    monkeypatch.setattr(runs, "PLACES", places)
    texts = periodic_texts(least)
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for ws in texts for w in ws], np.int64)
    size = np.array([len(ws) for ws in texts])
    begin = np.cumsum(size) - size
    s, e, q = runs.find_runs(ids, begin, size, least)
    got = sorted(zip(s.tolist(), (e - s).tolist(), q.tolist()))
    assert got == [(a + b, n, p) for b, ws in zip(begin.tolist(), texts) for a, n, p in naive_runs(ws, least)]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    # every stretch of the same length has one hash
    monkeypatch.setattr(runs._Hashes, "same", lambda self, at, lag, n: np.ones(len(at), bool))
    monkeypatch.setattr(runs, "SMALL_LAG", 2)
    test_runs_equal_all_pairs(monkeypatch, 12, 2, 1 << 20)


def test_split_segments_holds_no_rare_word():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 400, 5000)
    ids[1000:1100] = np.tile(np.arange(900, 910), 10)
    ids[3000:3012] = 7
    begin, size = np.array([0, 2500]), np.array([2500, 2500])
    start, length = runs.split_segments(ids, begin, size)
    assert any(s <= 1000 and s + n >= 1100 for s, n in zip(start, length)) and any(s <= 3000 and s + n >= 3012 for s, n in zip(start, length))
    for s, n in zip(start, length):
        assert n >= 12 and np.unique(ids[s:s + n], return_counts=True)[1].min() >= 2


def planted(i, ws):
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(ws)
    if h % 10 or not n:
        return ws
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[k] if k < a else ws[a + (k - a) % p] for k in range(n)]


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choice(["Ab", "ab", "é", "x", "y", "z\u00a0", "q"]) + rng.choice(["", str(rng.randint(0, 9))]) for _ in range(rng.randint(0, 70)))) for i in range(150)]
    rows += [(200 + i, " \t".join(ws)) for i, ws in enumerate(periodic_texts(5))]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "\t one\x0b"), (5, "again " * 20), (5, "again " * 20), (None, "null id " * 8), (None, None)]
    rows += [(10, "one two three " * 40_000), (11, " ".join(f"v{i % 30011}" for i in range(70_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_runs", F.lit("clash")).withColumn("g", F.lit(1)).withColumn("w", F.lit(2))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = runs.op13_periodic_runs(spark, str(tmp_path)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, text in rows:
        ws = planted(i, words_of(text)) if i is not None else words_of(text)
        if len(ws) > 50_000:
            whole = [(0, len(ws), 3 if i == 10 else 30011)]
            found = whole if ws == (ws[:whole[0][2]] * (len(ws) // whole[0][2] + 1))[:len(ws)] else None
            assert found, "the long texts are expected to stay as they are"
        else:
            found = naive_runs(ws)
        dropped = {k for a, n, p in found for k in range(a + p, a + n)}
        a, n, p = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        want.append((i, len(found), a, n, p, 1000 * n // p if found else None, sha("".join(f"{a},{n},{p}\n" for a, n, p in found)),
                     sha(" ".join(w for k, w in enumerate(ws) if k not in dropped))))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    full = runs.periodic_runs(spark.createDataFrame([(1, "a b " * 7 + "c")], "doc_id long, text string")).first()
    assert [tuple(r) for r in full.runs] == [(0, 14, 2)] and full.collapsed == "a b c"


def lower_words(text):
    return re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()).split()


def naive_scores(rows, vocabulary, model):
    """Base and model score of each text, token by token, each softmax summed over all symbols."""
    train = Counter()
    for i, t in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1:
            train.update(lower_words(t) + [b""])
    total, distinct = sum(train.values()), len(train)
    number = {w: i for i, w in enumerate(vocabulary.words[:vocabulary.symbols])}
    rest = [(w, n) for w, n in train.items() if w and w not in number]
    tokens, words = Counter(), Counter()
    for w, n in rest:
        tokens[logbilinear.word_class(w)] += n
        words[logbilinear.word_class(w)] += 1
    start = len(model.context) - 1
    out = []
    for i, t in rows:
        base = score = 0.0
        one = two = start
        ws = lower_words(t) + [b""]
        for w in ws:
            base += math.log10((train[w] + 0.5) / (total + 0.5 * (distinct + 1)))
            k = logbilinear.word_class(w)
            s = 0 if not w else 129 + number[w] if w in number else 1 + k
            q = model.context[one].astype(float) @ model.position[0] + model.context[two].astype(float) @ model.position[1]
            z = model.target.astype(float) @ q + model.bias
            score += (z[s] - np.log(np.exp(z).sum())) / math.log(10)
            if w and w not in number:
                score += math.log10((train[w] + 0.5) / (tokens[k] + 0.5 * (words[k] + 1)))
            one, two = s, one
        out.append((i, zlib.crc32(str("" if i is None else i).encode()) % 5 == 1, len(ws), sum(train[w] > 0 for w in ws), total, base, score))
    return out


def check_scores(spark, rows, symbols, dictionary):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("w", F.lit("clash")).withColumn("rid", F.lit(1)).withColumn("score", F.lit("x"))
    vocabulary, rest = logbilinear.learn_vocabulary(logbilinear.materialize(logbilinear.word_counts(docs), "t"), symbols, dictionary)
    model = logbilinear.train(docs, vocabulary)
    got = sorted(map(tuple, logbilinear.score(docs, vocabulary, rest, model).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))
    want = sorted(naive_scores(rows, vocabulary, model), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-9)
    assert np.allclose([r[6] for r in got], [r[6] for r in want], rtol=1e-4, atol=1e-3)
    return vocabulary, model


def test_logbilinear_scores_equal_a_softmax_per_token(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["The", "the", "cat", "É", "sat.", "on"]) + rng.choice(["", "", str(rng.randint(0, 30))]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (5, "repeated id"), (5, "repeated id"), (None, "null id the cat"), (None, None), (303, "unseen1 unseen2 the")]
    rows.append((304, "long text the " * 20_000))
    vocabulary, model = check_scores(spark, rows, 150, 4096)
    assert vocabulary.symbols == 21 < len(vocabulary.words) < vocabulary.distinct - 1 and len(model.bias) == 150
    # all probabilities of the next token, words outside the symbols and one unknown word a class included, are 1 together
    last, before, z = model.tables()
    p = np.exp(last[3][None, :] + before - z[3][:, None])
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)


def test_logbilinear_words_are_numbered_and_counted_in_one_go(spark):
    words = [b"the", b"cat", "É".encode()]
    asked = [b"cat", b"x", b"", b"concat", "É".encode(), b"the", b"\xff\xfe\xfd", b"at"]
    assert logbilinear.Lookup(words).of(asked).tolist() == [words.index(w) if w in words else -1 - logbilinear.word_class(w) for w in asked]
    assert logbilinear.Lookup([]).of([]).tolist() == []
    rows = [(i, t) for i, t in enumerate(["The the x", None, "É é cat\tx", "sat. sat. sat. the", "", "ab b"] * 3)]
    want = {}
    for i, t in rows:
        for w in lower_words(t) + [b""]:
            train, total = want.get(w, (0, 0))
            want[w] = train + (zlib.crc32(str(i).encode()) % 5 != 1), total + 1
    got = logbilinear.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {bytes(r.w): (r.train, r.total) for r in got} == want and len(got) == len(want)
    assert all(r.k == logbilinear.word_class(bytes(r.w)) for r in got)


def test_logbilinear_edges(spark):
    vocabulary, _ = check_scores(spark, [(i, "only held out") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1], 140, 1 << 18)
    assert vocabulary.tokens == 0
    check_scores(spark, [(1, None)], 140, 1 << 18)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert logbilinear.score_documents(empty).count() == 0


def test_logbilinear_beats_the_unigram_on_held_out_rows(spark):
    found = logbilinear.op11_logbilinear_scores(spark, SMALL).where("held_out").agg(
        F.sum("n_tokens").alias("n"), F.sum("base_score").alias("base"), F.sum("score").alias("score"), F.count(F.lit(1)).alias("rows")).first()
    assert found.rows > 150
    assert found.score / found.n > found.base / found.n + 0.05


def test_training_lowers_the_cost_of_a_pattern():
    rng = np.random.default_rng(0)
    words = [b"a", b"b", b"c"]
    vocabulary = logbilinear.Vocabulary(words, np.array([100, 100, 100]), 3, np.zeros(128), np.zeros(128), 10, 310, 4)
    target = 129 + (np.arange(30_000) + (rng.random(30_000) < 0.05)) % 3
    contexts = logbilinear.contexts(target, np.array([0]), 132)
    trainer = logbilinear.Trainer(logbilinear.Model.start(vocabulary), vocabulary.unigram(), [1])
    for _ in range(5):
        trainer.learn(target, *contexts)
    last, before, z = trainer.m.tables()
    assert (last[contexts[0], target] + before[contexts[1], target] - z[contexts]).mean() > -0.6
