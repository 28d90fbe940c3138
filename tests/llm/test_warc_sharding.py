"""op1 and op9 against brute force, with the edge rows that their docstrings define."""

import base64
import collections
import hashlib
import random
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from keelson.llm import sharding, warc
from keelson.llm.common import materialize


def b32(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def pages():
    rng = random.Random(1)
    parts = ["\r", "\n", "\r\n", "a", "é", "WARC/1.0\r\n", "x" * 30, "\r\n\r\n"]
    rows = [(i, None if i % 7 == 0 else f"http://x/{i}\r\ny", None if i % 11 == 0 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))))
            for i in range(120)]
    return rows + [(None, "u", "dup"), (500, "u", "dup"), (501, "u", "dup"), (501, "v", "dup"), (None, "u", "only"),
                   (502, "u", "dup2"), (502, "u", "dup2"), (503, "u", "dup2")]


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_warc_round_trip(spark, tmp_path, chunk):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    warc.write_archives(df, str(tmp_path / "a"), chunk_bytes=chunk)
    chunks = warc.read_chunks(spark, str(tmp_path / "a"), chunk_bytes=chunk).collect()
    body, done = collections.defaultdict(bytes), {}
    for c in chunks:
        assert len(c.chunk) <= chunk
        assert c.chunk_offset == len(body[c.record_id]) or c.page_id in (None, 501, 502)
        body[c.record_id] += bytes(c.chunk)
        if c.is_last:
            done[c.page_id] = c
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, _, t in rows[:120]:
        b = (t or "").encode()
        c = done[i]
        assert (c.payload_bytes, c.payload_digest) == (len(b), b32(b))
        first = least[t or ""]
        assert (c.record_type, c.refers_to) == (("response", None) if first == i else ("revisit", first))
        if first == i:
            assert body[c.record_id] == b and c.running_sha1 == b32(b)
    got = sorted((c.page_id or -1, c.record_type, c.refers_to or -1) for c in chunks if c.is_last and (c.page_id is None or c.page_id >= 500))
    assert got == sorted([(-1, "revisit", 500), (-1, "response", -1), (500, "response", -1), (501, "revisit", 500), (501, "revisit", 500),
                          (502, "response", -1), (502, "response", -1), (503, "revisit", 502)])


def test_warc_rejects_broken_segments():
    with pytest.raises(ValueError, match="does not follow"):
        list(warc.parse_chunks([b"WARC/1.0", b"WARC-Type: continuation", b"WARC-Record-ID: <urn:page:1#2>", b"WARC-Segment-Number: 2",
                                b"WARC-Segment-Origin-ID: <urn:page:1>", b"Content-Length: 1", b"", b"x", b""]))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.parse_chunks([b"WARC/1.0", b"WARC-Type: response", b"WARC-Record-ID: <urn:page:1>", b"Content-Length: 100", b"", b"HTTP/1.1 200 OK", b"", b"x"]))


def test_warc_empty(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.records(warc.read_chunks(spark, str(tmp_path / "a"))).count() == 0


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * sharding.MULTIPLIER + 1) % sharding.WORD
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark):
    rows = [(i, None if i % 9 == 0 else "é" * (i % 5)) for i in range(300)] + [(7, "again"), (7, "again"), (7, "other"), (None, None), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_n", F.lit(1)).withColumn("shard", F.lit("clash"))
    got = sharding.shard_documents(df, 16).collect()
    assert sorted((r.doc_id is None, r.doc_id, r["size"], r.text_crc32) for r in got) == sorted(
        (i is None, i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = collections.defaultdict(list)
    for r in got:
        key = xxhash.xxh64("" if r.doc_id is None else str(r.doc_id), seed=42).intdigest()
        assert (r.shard, r.grown_shard, r.law) == (jump(key, 16), jump(key, 17), "key")
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(df.limit(0)).count() == 0


def test_many_shards_and_kept_columns(spark):
    out = sharding.with_shard(spark.range(500).withColumn("x", F.lit("kept")), "id", 1000).collect()
    assert all(r.x == "kept" and r.shard == jump(xxhash.xxh64(str(r.id), seed=42).intdigest(), 1000) for r in out)
    assert materialize(spark.range(1), "t").count() == 1
