"""op5, op6, op7 and op8 against brute force or held-out accuracy."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keelson.llm import langid, pii, recompression, simhash

SMALL = "/root/testdata/sf0.01"


def doc_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.lit(1)).withColumn("fp", F.lit("clash"))


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64(" ".join(w[j:j + 4]), seed=42).intdigest() for j in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_simhash(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice(["Ab", "cd", "É", "f\tg", "hi", "jk"]) + str(rng.randint(0, 60)) for _ in range(rng.randint(0, 90))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.replace("1", "2", 1)) for i, t in enumerate(base)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "One"), (5, base[5]), (5, "other text"), (None, base[6]), (None, "alone")]
    rows.append((400, "long words " * 70_000))
    got = simhash.simhash_components(doc_frame(spark, rows)).collect()
    fps = [(i, fingerprint(t)) for i, t in rows if i != 400] + [(400, fingerprint("long words " * 70))]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(fps):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    want = [(i, "%016x" % f, least.get(find(x))) for x, (i, f) in enumerate(fps)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or -1)
    found = [(r.doc_id, r.fingerprint, r.component_id) for r in got]
    assert sorted((x for x in found if x[0] != 400), key=key) == sorted((x for x in want if x[0] != 400), key=key)
    assert len(found) == len(rows)


def test_simhash_empty_and_keep_one(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (0, "x y z"), (0, "x y z"), (3, "x y z"), (None, "a b c d e"), (None, "only null")]
    left = simhash.keep_one(doc_frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in left) == [(False, 0, "x y z"), (False, 1, "a b c d e"), (True, 0, "only null")]
    assert left[0].fp == "clash"
    assert simhash.simhash_components(doc_frame(spark, rows).limit(0)).count() == 0


def test_tiles_match_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2 ** 63, 6).astype(np.uint64)
    values = np.unique(np.array([int(base[rng.integers(6)]) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(150)], np.uint64))
    a, b = values[::2], values[1::2]

    def components(edges):
        parent = {int(v): int(v) for v in values}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for u, v in edges:
            parent[find(int(u))] = find(int(v))
        groups = {}
        for v in values:
            groups.setdefault(find(int(v)), set()).add(int(v))
        return {frozenset(g) for g in groups.values()}
    edges = [e for x, y in ((a, a), (b, b), (a, b)) for e in zip(*simhash.tile_links(x, x if y is x else y, 4, rows=7))]
    assert components(edges) == components([(u, v) for u in values for v in values if (int(u) ^ int(v)).bit_count() <= 4])


@pytest.mark.parametrize("window, rounds, letters", [(4, 2, 3), (6, 4, 2), (20, 4, 2), (20, 1, 8)])
def test_recompression(spark, window, rounds, letters):
    rng = random.Random(window * 10 + rounds)
    base = [" ".join(rng.choice("abcdefgh"[:letters]) for _ in range(rng.randint(0, 80))) for _ in range(40)]
    docs = [(i, t if rng.random() < 0.5 else base[rng.randrange(40)] + "\n" + t[:40]) for i, t in enumerate(base)]
    docs += [(100, None), (101, ""), (102, "a " * 300), (103, "a b " * 100), (104, "É\x0b x " * 30)]
    seen, want = set(), []
    for i, t in docs:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(ws)
        for s in range(len(ws) - window + 1):
            k = tuple(ws[s:s + window])
            if k in seen:
                gone[s:s + window] = [True] * window
            seen.add(k)
        kept = " ".join(w for w, d in zip(ws, gone) if not d)
        want.append((i, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = recompression.remove_repeats(doc_frame(spark, docs), window=window, rounds=rounds, keep_text=True)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_recompression_by_blocks_equals_one_by_one():
    """Range minima and maxima, equal windows and masks, against plain loops."""
    rng = np.random.default_rng(3)
    for size, longest in ((1, 1), (7, 3), (60, 20), (300, 20)):
        first = rng.integers(0, size, 80)
        last = np.minimum(first + rng.integers(0, longest, 80), size - 1)
        key = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        least = [min([int(k) for f, e, k in zip(first, last, key) if f <= at <= e], default=int(recompression.NONE)) for at in range(size)]
        assert recompression.spread_minimum(first, last, key, size, longest).tolist() == least
        value = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        assert recompression.range_maximum(first, last, value, longest).tolist() == [int(value[f:e + 1].max()) for f, e in zip(first, last)]
    for n, kinds in ((0, 1), (1, 1), (200, 2), (200, 6), (200, 1000)):
        owner, a, b = (rng.integers(0, kinds, n) for _ in range(3))
        entries = list(zip(owner.tolist(), a.tolist(), b.tolist()))
        assert recompression._least_equal(owner, a, b).tolist() == [entries.index(e) for e in entries]
    windows = recompression.Windows([recompression.word_hashes([b"w%d" % i for i in range(n)]) for n in (100, 3, 0, 200)], 5)
    mask = rng.random(len(windows.starts)) < 0.3
    owner, word, bits = windows.words_of_bits(mask)
    back = windows.mask_of([(word[owner == i].astype(np.int32), bits[owner == i].view(np.int64)) for i in range(4)])
    assert (back == mask).all()
    memo = recompression.WordHashes()
    assert recompression.word_hashes([b"a", b"", b"word" * 9]).tolist() == [memo[w] for w in (b"a", b"", b"word" * 9)]


def test_recompression_edges(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(7, text), (7, text), (None, text), (9, text + " more"), (None, "x")]
    got = recompression.remove_repeats(doc_frame(spark, rows)).collect()
    # rows of one id are not earlier than one another; a null id comes last
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 1, 0), (0, 30, 30), (7, 30, 0), (7, 30, 0), (9, 31, 30)]
    assert recompression.remove_repeats(doc_frame(spark, rows).limit(0)).count() == 0


def test_recompression_of_rows_that_share_an_id(spark):
    """Rows of one id (or none) are not earlier than one another; what is sent to each is bounded by its own text."""
    rng = random.Random(61)
    vocabulary = [f"v{i}" for i in range(400)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(25)) for _ in range(6)]
    rows = []
    for i in range(300):
        i_or_none = None if i % 3 == 0 else 50 if i % 3 == 1 else i
        own = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))
        rows.append((i_or_none, " ".join([rng.choice(passages), own, rng.choice(passages), own])))
    rows += [rows[0], rows[1], rows[1], (None, None), (50, "")]
    order = {id(r): (1 << 63) - 1 if r[0] is None else r[0] for r in rows}
    least, want = {}, []
    for r in rows:
        ws = (r[1] or "").split()
        for k in range(len(ws) - 19):
            g = tuple(ws[k:k + 20])
            least[g] = min(least.get(g, 1 << 63), order[id(r)])
    for r in rows:
        ws, seen = (r[1] or "").split(), set()
        gone = [False] * len(ws)
        for k in range(len(ws) - 19):
            g = tuple(ws[k:k + 20])
            if g in seen or least[g] < order[id(r)]:
                gone[k:k + 20] = [True] * 20
            seen.add(g)
        want.append((r[0] is None, r[0] or 0, len(ws), sum(gone), " ".join(w for w, d in zip(ws, gone) if not d)))
    got = recompression.remove_repeats(doc_frame(spark, rows), keep_text=True).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in got) == sorted(want)


def test_recompression_of_many_null_ids(spark):
    rng = random.Random(62)
    rows = [(None, " ".join(f"{rng.getrandbits(40):x}" for _ in range(60)) + " " + "same passage of words " * 6) for _ in range(2000)]
    got = recompression.remove_repeats(doc_frame(spark, rows)).groupBy("n_words").agg(F.count(F.lit(1)).alias("n"), F.min("n_removed").alias("least"), F.max("n_removed").alias("most")).first()
    assert tuple(got) == (84, 2000, 20, 20)   # the passage repeats itself within each row


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for i, (k, p) in enumerate(pats.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(d) <= 19 and luhn(d),
                  "phone": 10 <= len(d) <= 15}[k]
            if ok:
                out.append((m.start(), i, m.end()))
    return ",".join(f"{list(pats)[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii_base_spans(spark):
    rng = random.Random(3)
    parts = ["a", "Z.", "%", "@", "@b.c", "_", "-", "1", "23", "255.", "256.", "0.0.0.1", " ", "\n", "é", "😀", "+", "+1 ", "(", ")", "4111 1111 1111 1111",
             "x@y.z_d@e.f", "12.34.56.78.9", "+1 (258) 555-1234", "00.1.2.3"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    rows += [(5000, None), (5001, ""), (5002, "1" * 20000), (5003, "a@b" + ".c" * 9000), (5004, "a" * 50000), (5, "dup 1.2.3.4"), (None, "x@y.zz")]
    got = pii.find_pii(doc_frame(spark, rows)).collect()
    want = sorted((i or -1, base_spans(t), hashlib.sha256(base_spans(t).encode()).hexdigest()) for i, t in rows)
    assert sorted((r.doc_id or -1, ",".join(s for s in r.spans.split(",") if s and not s.startswith("id:")), r.base_sha256) for r in got) == want
    assert pii.find_pii(doc_frame(spark, rows).limit(0)).count() == 0


def test_pii_contexts_and_redaction(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "run", "sun"]
    rows = []
    for i in range(60):
        t = " ".join(rng.choice(words) for _ in range(20))
        if i < 30:
            t += f" contact email: user{i}@mail.com {rng.choice(words)}"
        elif i < 36:
            t += f" contact email: user{i}#mail9 {rng.choice(words)}"
        rows.append((i, t + (" chapter 19 alpha" if i > 50 else "")))
    df = doc_frame(spark, rows)
    found = {r.doc_id: r.spans for r in pii.find_pii(df).where("n_id > 0").collect()}
    assert set(found) == set(range(30, 36))
    for i, s in found.items():
        _, a, b = s.split(":")
        assert rows[i][1][int(a):int(b)] == f"user{i}#mail9"
    clean = {r.doc_id: r for r in pii.redact(df).collect()}
    assert "email: [EMAIL]" in clean[3].text and "email: [ID]" in clean[33].text and clean[55].text == rows[55][1] and clean[3].fp == "clash"


def naive_ids(rows, rounds=pii.ROUNDS, support=pii.MIN_SUPPORT, least=pii.MIN_CONFIDENCE):
    """Added spans of each row, from a graph of patterns and identifiers in plain Python."""
    places, edges, seen = collections.Counter(), collections.Counter(), []
    for r, (_, t) in enumerate(rows):
        t = t or ""
        found = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        base = [tuple(map(int, s.split(":")[1:])) for s in base_spans(t).split(",") if s]
        before = ["", ""]
        for a, b, w in found:
            patterns = [(before[1],), (before[0], before[1])] if before[1] else []
            places.update(patterns)
            core = w.strip(pii.EDGES)
            if re.search("[0-9@]", w) and core:
                start = a + len(w) - len(w.lstrip(pii.EDGES))
                seed = any(x < start + len(core) and y > start for x, y in base)
                seen.append((r, start, start + len(core), core, patterns, seed))
            before = [before[1], w.lower()]
    for _, _, _, w, patterns, seed in seen:
        for p in patterns:
            edges[p, w, seed] += 1
    pairs = {(p, w) for p, w, _ in edges}
    enough = {p for p, n in collections.Counter(p for p, _ in pairs).items() if n >= support}
    trusted, rated = {}, {}
    for _ in range(rounds):
        weights = {(p, w): edges[p, w, True] + edges[p, w, False] * trusted.get(w, 0) for p, w in pairs if p in enough}
        rated = {}
        for p in enough:
            own = [x for (q, _), x in weights.items() if q == p]
            assert sum(own) <= places[p] + 1e-9
            if sum(x > 0 for x in own) >= support and sum(own) / places[p] >= least:
                rated[p] = sum(own) / places[p]
        doubt = {}
        for p, w in pairs:
            if p in rated and edges[p, w, False]:
                doubt[w] = doubt.get(w, 1) * (1 - min(rated[p], 1 - 1e-9))
        trusted = {w: 1 - d for w, d in doubt.items() if 1 - d >= least}
    out = [set() for _ in rows]
    for r, a, b, w, patterns, seed in seen:
        if not seed and w in trusted and any(p in rated for p in patterns):
            out[r].add((a, b))
    return out


def test_pii_contexts_equal_a_plain_graph(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(0, 25)):
            kind = rng.random()
            words.append(rng.choice(["id", "Ref:", "mail", "no2", "x" * 50, "^", "und"]) if kind < 0.45 else f"user{rng.randint(0, 30)}@mail.com" if kind < 0.65
                         else f"10.0.0.{rng.randint(0, 9)}" if kind < 0.7 else f"key{rng.randint(0, 25)}" if kind < 0.85 else rng.choice(["(7)", "@", "1,", "\u0130d"]))
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(5, "id user1@mail.com"), (None, "id key1"), (None, None), (900, "id " * 20_000 + "key7 " + "9" * 5_000)]
    want = naive_ids(rows)
    got = {}
    for r in pii.find_pii(doc_frame(spark, rows)).collect():
        got.setdefault((r.doc_id, r.base_sha256), []).append({tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("id:")})
    assert sum(map(len, want)) > 20
    for (i, t), ids in zip(rows, want):
        assert ids in got[i, hashlib.sha256(base_spans(t).encode()).hexdigest()], (i, t, ids)


def test_pii_adjacent_candidates_have_their_true_context(spark):
    rows = [(i, f"beta no2 user{i}@mail.com and more") for i in range(5)] + [(5, "no2 user9@mail.com and more")]
    rows += [(100 + i, f"text gamma delta no2 item{i} word") for i in range(200)]
    found = pii.find_pii(doc_frame(spark, rows)).agg(F.sum("n_id"), F.sum("n_email")).first()
    assert tuple(found) == (0, 6)


def test_pii_contexts_of_long_words(spark):
    label = "customer-" + "x" * 300
    rows = [(i, f"a {label} user{i}@mail.com") for i in range(8)] + [(20, f"b {label} hidden7")] + [(30 + i, f"c {label}y word{i}") for i in range(9)]
    assert {r.doc_id for r in pii.find_pii(doc_frame(spark, rows)).where("n_id > 0").collect()} == {20}


def test_langid_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(90001, None, "en"), (90002, "123 ... \n", "en"), (90003, "", None), (None, "the and of the", None)],
                                  "doc_id long, text string, lang string")
    docs = docs.select("doc_id", "text", "lang").unionAll(extra)
    net = langid.fit(docs)
    got = langid.identify(docs, net).join(docs.withColumnRenamed("text", "t"), "doc_id").select(
        "doc_id", "lang", "lang_pred", "score", langid.held_out(F.col("doc_id")).alias("held_out")).toPandas()
    fold = got[got.held_out & (got.doc_id < 90000)]
    assert len(fold) > 150 and (fold.lang == fold.lang_pred).mean() > 0.97
    assert set(got[got.doc_id > 90000].lang_pred) == {"und"}
    assert got.score.between(0, 1).all()
    assert langid.identify(docs, None).where("lang_pred <> 'und'").count() == 0
    assert langid.fit(docs.limit(0)) is None


def _forward(net, text):
    """The network on one text, one byte at a time: class probabilities."""
    total = [0.0] * len(net.langs)
    for at in range(0, len(text), langid.WINDOW):
        part = text[at:at + langid.WINDOW]
        window = part + bytes(langid.WINDOW - len(part))
        hidden = []
        for width, table in net.filters.items():
            for f in range(langid.FILTERS):
                best = max(sum(float(table[k][window[i + k]][f]) for k in range(width)) for i in range(langid.WINDOW - width + 1))
                hidden.append(max(0.0, best + float(net.bias[len(hidden)])))
        weight = sum(b != 0 for b in window)
        for c in range(len(net.langs)):
            total[c] += weight * (float(net.out_bias[c]) + sum(h * float(net.dense[i][c]) for i, h in enumerate(hidden)))
    logits = [t / len(text) for t in total]
    top = max(logits)
    e = [math.exp(z - top) for z in logits]
    return [x / sum(e) for x in e]


def _random_network(seed, langs=("aa", "bb", "cc")):
    rng = np.random.default_rng(seed)
    hidden = langid.FILTERS * len(langid.WIDTHS)
    return langid.Network(list(langs), {w: rng.normal(0, 0.5, (w, 256, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS},
                          rng.normal(-1, 1, hidden).astype(np.float32), rng.normal(0, 0.5, (hidden, len(langs))).astype(np.float32),
                          rng.normal(0, 0.5, len(langs)).astype(np.float32))


def test_langid_predictions_equal_a_walk_over_bytes():
    rng = np.random.default_rng(3)
    texts = ["a".encode(), "Grüße, 北京".encode(), bytes(rng.integers(1, 256, langid.WINDOW, np.uint8)), bytes(rng.integers(1, 256, langid.WINDOW + 1, np.uint8)),
             bytes(rng.integers(0, 256, 3 * langid.WINDOW - 5, np.uint8)), b"\0x\0"]
    for seed in range(2):
        net = _random_network(seed)
        got = langid.predict(net, texts, net.tables())
        for row, text in zip(got, texts):
            assert row.tolist() == pytest.approx(_forward(net, text), abs=1e-4)


def test_langid_edge_rows(spark):
    net = _random_network(5)
    long = "päivää maailma " * 60_000  # more windows than are held at once
    rows = [(1, None), (2, ""), (3, "123 ...\n"), (4, "word"), (4, "word"), (None, "word"), (5, long), (6, "word " * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang_pred", F.lit("clash")).withColumn("b", F.lit(1)).withColumn("letters", F.lit(0))
    got = langid.identify(df, net).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "th", "lang_pred", "score"}
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert [by_id[i] for i in (1, 2, 3)] == [[("und", 0.0)]] * 3
    assert len(set(by_id[4] + by_id[None])) == 1 and len(by_id[4]) == 2
    for i, text in ((4, "word"), (6, "word " * 2000)):
        want = _forward(net, text.encode())
        assert by_id[i][0][0] == net.langs[want.index(max(want))] and by_id[i][0][1] == pytest.approx(max(want), abs=1e-4)
    whole = langid.predict(net, [long.encode()], net.tables())[0]
    assert by_id[5] == [(net.langs[int(whole.argmax())], pytest.approx(whole.max(), abs=1e-9))]
    # equal scores: the first language by name
    net.dense[:], net.out_bias[:] = 0, 0
    assert {r.lang_pred for r in langid.identify(df.where("doc_id = 4"), net).collect()} == {"aa"}
    assert langid.identify(df.limit(0), net).count() == 0
    clean = langid.keep_identified(df.withColumn("lang", F.lit(None).cast("string")))
    assert clean.count() == 0 and "lang_pred" in clean.columns  # nothing to learn from: every text is und
