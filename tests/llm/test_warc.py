import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from keelson.llm import queries, warc
from tests.oracle import assert_same


def archive(rng, n, nasty=True):
    """(bytes, [(offset, page id, payload)]) of records, some payloads full of gzip magic."""
    data, known = b"", []
    for i in range(n):
        kind = rng.randrange(5)
        payload = [b"", b"<p>x</p>" * rng.randrange(400), rng.randbytes(rng.randrange(3000)), warc.MAGIC * 300, gzip.compress(b"WARC/1.0 no")][kind if nasty else 1]
        known.append((len(data), i, payload))
        data += warc.record(i, f"http://h/{i}", payload, warc.base32_sha1(payload), None, False)
    return data, known


def read(data, start, end, **options):
    return [(at, warc._number(f[b"warc-record-id"]), block.partition(b"\r\n\r\n")[2]) for at, f, block in warc.records(io.BytesIO(data), len(data), start, end, **options)]


@pytest.mark.parametrize("step", [1000, 4097, 10**9])
def test_every_record_has_one_owner(step):
    data, known = archive(random.Random(4), 120)
    found = [x for s in range(0, len(data), step) for x in read(data, s, min(len(data), s + step))]
    assert found == known


def test_borders_at_every_byte():
    data, known = archive(random.Random(1), 6)
    for cut in range(0, len(data), 3):
        assert read(data, 0, cut) + read(data, cut, len(data)) == known


def test_an_archive_inside_a_payload_is_not_read():
    inner = warc.record(7, "http://in", b"inner", warc.base32_sha1(b"inner"), None, False)
    import zlib

    body = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <x>\r\nWARC-Date: d\r\nContent-Length: {len(inner)}\r\n\r\n".encode() + inner + b"\r\n\r\n"
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    outer = packer.compress(body) + packer.flush()
    at = outer.index(inner)
    last = warc.record(9, "http://last", b"z", warc.base32_sha1(b"z"), None, False)
    data = outer + last
    assert [i for _, i, _ in read(data, at - 2, len(data))] == [9]
    assert [o for o, _, _ in read(data, 0, len(data))] == [0, len(outer)]


def test_damage_costs_one_record():
    data, known = archive(random.Random(2), 30, nasty=False)
    bad = bytearray(data)
    spot = known[10][0] + 40
    bad[spot : spot + 4] = b"\xff\xff\xff\xff"
    found = [i for _, i, _ in read(bytes(bad), 0, len(bad), skip_damaged=True)]
    assert 10 not in found and len(found) == 29
    with pytest.raises(warc.Damaged):
        read(bytes(bad), 0, len(bad))
    with pytest.raises(warc.Damaged):
        read(bytes(bad), 0, known[10][0])
    with pytest.raises(warc.Damaged, match="at 0"):
        read(b"x" + data, 0, len(data))


def test_records_longer_than_blocks_and_ranges():
    rng = random.Random(8)
    payload = rng.randbytes(400_000)
    data = b"".join(warc.record(i, None, payload, warc.base32_sha1(payload), None, False) for i in range(3))
    found = [x for s in range(0, len(data), 50_000) for x in read(data, s, s + 50_000)]
    assert [(i, p) for _, i, p in found] == [(0, payload), (1, payload), (2, payload)]


def brute(rows):
    first = {}
    for i, _, html in rows:
        p = (html or "").encode()
        first.setdefault(p, []).append(i)
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        ids = [x for x in first[p] if x is not None]
        head = min(ids) if ids else None
        revisit = i != head
        out.append((i, len(p), warc.base32_sha1(p), "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, "http://a", None), (2, None, ""), (3, "http://c\r\nX: y", "é€\r\n\r\n")],
        [(i, f"http://h/{i}", "same") for i in (5, 3, 9)] + [(3, "http://h/3", "same")],
        [(None, "u", "x"), (None, "u", "x"), (4, "u", "x"), (None, "u", "alone")],
        [(1, "http://a", "x"), (2, "http://b/" + "long" * 750_000, "y"), (3, "http://c", "z")],
        [(i, "u", "") for i in range(30)] + [(None, "u", "")],
        [(i, "u", "big " * 90_000 if i % 4 == 0 else f"page {i}") for i in range(40)],
    ],
)
def test_round_trip(spark, rows, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 700)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "sha1": F.lit("x"), "same": F.lit(2)}).repartition(3)
    found = warc.round_trip(df)
    got = found.select("id", "payload_bytes", "digest", "type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    whole = {(r["id"], bytes(r["payload"])) for r in warc.resolve(found).collect()}
    assert whole == {(i, (h or "").encode()) for i, _, h in rows}


def test_records_lost_on_the_way_are_reported(spark, monkeypatch):
    df = spark.createDataFrame([(i, "u", f"page {i}") for i in range(9)], "page_id long, url string, html string")
    whole = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda *a, **k: whole(*a, **k).where("id <> 4"))
    with pytest.raises(warc.Damaged, match="written"):
        warc.round_trip(df)


def test_query_equals_sql(spark, sf_dir):
    assert_same(queries.op8_warc_roundtrip(spark, sf_dir), queries.ORACLE_SQL["op8_warc_roundtrip"], sf_dir)
