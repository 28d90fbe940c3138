"""Landed files: whole-file batches and envelope lines, with everything that can be broken."""

import tempfile

from pyspark.sql import functions as F

from keelson.sources import payload_files as files
from keelson.sources import payloads


def test_batches_are_read_by_path_and_position(spark):
    good = '[{"hourly": {"time": ["2024-01-01T00:00"], "wave_height": [1.0]}},\n {"hourly": {"time": [], "wave_height": []}}]'
    rows = [(0, good), (1, '{"hourly": {"time": ["2024-01-01T00:00"], "wave_height": [2.0]}}'), (2, good[:40]), (3, ""), (4, "[]")]
    folder = tempfile.mkdtemp(prefix="keelson-land-") + "/m"
    files.land_batches(spark.createDataFrame(rows, "batch_id int, payload string"), folder)
    scanned = files.scan_batches(spark, folder)
    assert {r.batch_id: r.payload.strip() for r in scanned.collect() if r.batch_id < 3} == {b: p for b, p in rows[:3]}
    ledger = {r.batch_id: (r.ok, r.n_objects, r.error) for r in files.file_ledger(scanned, "marine", payloads.MARINE_SCHEMA).collect()}
    assert ledger[0] == (True, 2, None) and ledger[1] == (True, 1, None) and ledger[2] == (False, 0, files.ERR_BROKEN_FILE) and ledger[4] == (True, 0, None)
    asked = spark.createDataFrame([(b, p, f"port{b}{p}") for b in range(5) for p in range(2)], "batch_id int, pos int, port string")
    wind = spark.createDataFrame([(b, '[{"hourly": {"wind_speed_10m": [5.0]}}, {}]') for b in range(5)], "batch_id int, payload string")
    got, ports = payloads.decode_live(scanned, wind, asked)
    assert {(r.port, r.wave_height_m) for r in got.collect()} == {("port00", 1.0), ("port10", 2.0)}
    assert ports.count() == 10 and ports.where("ok").count() == 2 and ports.where("NOT ok AND error IS NULL").count() == 0


def test_lines_with_corrupt_records(spark):
    lines = ['{"k": 1, "payload": "{\\"a\\": 1}"}', '{"k": 2, "payload": "x', '{"payload": "no key"}', '{"k": 3, "payload": "p"}', '{"k": 3, "payload": "p"}',
             '{"k": 4, "payload": null}', "not json"]
    folder = tempfile.mkdtemp(prefix="keelson-land-") + "/l"
    files.land_lines(spark.createDataFrame([(x,) for x in lines], "value string"), folder)
    scanned = files.scan_lines(spark, folder, "k").cache()
    assert tuple(files.line_ledger(scanned, "k").first()) == (7, 3)
    assert scanned.where(F.col("path").contains("/l/")).count() == 7
    asked = spark.createDataFrame([(i,) for i in range(1, 6)], "k long")
    got = {r.k: (r.answered, r.payload) for r in files.answered(asked, scanned, "k", "{}").collect()}
    assert got == {1: (True, '{"a": 1}'), 2: (False, "{}"), 3: (True, "p"), 4: (False, "{}"), 5: (False, "{}")}


def test_a_response_cut_short_fails_only_its_ports(spark):
    from keelson.plans.catalog_files import BROKEN_BATCH, q_file_ledger, q_landed_ledger
    from table_dirs import SMALL
    bad = {(r.kind, r.batch_id) for r in q_file_ledger(spark, SMALL).where("NOT ok").collect()}
    assert bad == {("wind", BROKEN_BATCH)}
    parse = q_landed_ledger(spark, SMALL).where(F.col("error").startswith(payloads.ERR_PARSE)).collect()
    assert {r.batch_id for r in parse} == {BROKEN_BATCH, 2} and len(parse) == 5
