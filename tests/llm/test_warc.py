import base64
import gzip
import hashlib
import random
import time

from gridwx.llm import warc


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "?") for i, u, h in rows], "page_id long, url string, html string, content string")


def test_round_trip(spark):
    big = "<p>" + "é" * 300_000
    rows = [(i, f"http://h/{i}", f"<p>{i % 4}</p>") for i in range(30)] + [(50, None, None), (51, "u", ""), (52, "x\r\ny", "WARC/1.1\r\n\r\n"), (53, "b", big), (None, "n", "<p>1</p>"), (54, "d", "same"), (54, "d", "same")]
    archives = warc.write_archives(warc.mark_revisits(pages(spark, rows)), 500)
    found = warc.read_archives(archives).collect()
    assert all(r["item"] == "record" for r in found) and len(found) == len(rows)
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", -1))
    for r in found:
        if r["page_id"] is None:
            assert r["record_type"] == "response"
            continue
        html = next(h or "" for i, _, h in rows if i == r["page_id"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), digest(html.encode()))
        response = last[html] == r["page_id"]
        assert r["record_type"] == ("response" if response else "revisit")
        assert r["refers_to"] == (None if response else last[html])
        assert r["payload"] is None if not response else bytes(r["payload"]) == html.encode()


def test_files_in_a_folder(spark, tmp_path):
    rows = [(i, "u", f"<p>é{i % 7}</p>" * (i + 1)) for i in range(40)]
    files = warc.save_archives(warc.write_archives(warc.mark_revisits(pages(spark, rows)), 900), f"{tmp_path}/warc")
    found = warc.read_archives(files).collect()
    assert sorted(r["page_id"] for r in found) == list(range(40)) and all(r["item"] == "record" for r in found)
    assert len({r["archive"] for r in found}) > 4
    for path in {r["archive"] for r in found}:
        assert gzip.open(path.removeprefix("file:")).read().startswith(b"WARC/1.1\r\n")


def members(n, plain=False):
    data = [warc.record(i, f"u{i}", f"payload {i}".encode() * 20, digest(f"payload {i}".encode() * 20), "response", None) for i in range(n)]
    return data if plain else [warc.gzip_member(d) for d in data]


def ids(data):
    return [int(h["warc-page-id"]) for item, *_, h, _ in warc.salvage(data) if item == "record"]


def gaps(data):
    return [(s, e) for item, s, e, *_ in warc.salvage(data) if item == "gap"]


def test_salvage_resumes_after_damage():
    for plain in (False, True):
        parts = members(6, plain)
        whole = b"".join(parts)
        assert ids(whole) == list(range(6)) and gaps(whole) == []
        starts = [sum(map(len, parts[:i])) for i in range(7)]
        broken = bytearray(whole)
        for at in range(starts[2] + 30, starts[3] - 8):
            broken[at] ^= 0x5A
        assert ids(bytes(broken)) == [0, 1, 3, 4, 5]
        assert gaps(bytes(broken)) == [(starts[2], starts[3])]
        cut = whole[: starts[5] + 20]
        assert ids(cut) == [0, 1, 2, 3, 4] and gaps(cut) == [(starts[5], len(cut))]
        noisy = b"noise" + whole[: starts[1]] + b"\x1f\x8b\x08 junk WARC/1.0\r\n" + whole[starts[1] :]
        assert ids(noisy) == list(range(6))
        assert sum(e - s for s, e in gaps(noisy)) == len(noisy) - len(whole)
    assert list(warc.salvage(b"")) == []


def test_records_of_a_broken_member_are_kept():
    data = members(6, plain=True)
    broken = data[2][:-40] + b"?" * 40
    member = warc.gzip_member(b"".join([*data[:2], broken, *data[3:]]))
    found = list(warc.salvage(member))
    assert [int(x[4]["warc-page-id"]) for x in found if x[0] == "record"] == [0, 1, 3, 4, 5]
    starts = [sum(map(len, data[:i])) for i in range(4)]
    assert [x[1:4] for x in found if x[0] == "gap"] == [(0, len(member), (starts[2], starts[3]))]
    rng = random.Random(1)
    big = [warc.record(i, "u", bytes(rng.randrange(256) for _ in range(70_000)), "x", "response", None) for i in range(5)]
    member = bytearray(warc.gzip_member(b"".join(big)))
    member[-300] ^= 0xFF
    assert set(ids(bytes(member))) >= {0, 1, 2} and gaps(bytes(member)) == [(0, len(member))]


def test_no_damage_breaks_the_reader():
    """Any byte flips in plain records and their headers, and numbers of any kind, leave the other records."""
    rng = random.Random(7)
    data = members(6, plain=True)
    starts = [sum(map(len, data[:i])) for i in range(7)]
    for _ in range(300):
        broken = bytearray(b"".join(data))
        hit = [starts[2] + rng.randrange(starts[3] - starts[2]) for _ in range(rng.randrange(1, 30))]
        for at in hit:
            broken[at] = rng.randrange(256)
        found = {h.get("warc-page-id") for item, *_, h, _ in warc.salvage(bytes(broken)) if item == "record"}
        assert set("01345") <= found
    for length in ("²", "9" * 5000, "-1", "", "1e3", "٣", "9" * 18):
        odd = b"WARC/1.1\r\nWARC-Page-ID: 77\r\nContent-Length: " + length.encode() + b"\r\n\r\nx\r\n\r\n"
        assert ids(data[0] + odd + data[1]) == [0, 1]
        assert gaps(data[0] + odd + data[1]) == [(len(data[0]), len(data[0]) + len(odd))]
    cut = data[1][: data[1].index(b"Content-Length") + 20]
    assert ids(data[0] + cut + data[2]) == [0, 2] and gaps(data[0] + cut + data[2]) == [(len(data[0]), len(data[0]) + len(cut))]


def test_numbers_beyond_64_bits_are_null(spark):
    record = warc.record(1, "u", b"p", digest(b"p"), "response", None)
    odd = record.replace(b"WARC-Page-ID: 1", b"WARC-Page-ID: " + b"9" * 30)
    found = warc.read_archives(spark.createDataFrame([("a", record + odd)], "path string, content binary")).collect()
    assert [(r["item"], r["page_id"], r["payload_bytes"]) for r in found] == [("record", 1, 1), ("record", None, 1)]


def test_time_is_in_proportion():
    def seconds(unit, n):
        began = time.process_time()
        assert [x[0] for x in warc.salvage(unit * n)] == ["gap"]
        return time.process_time() - began

    for unit in (b"WARC/1.0\r\n", b"a:WARC/1.0\r\n", b"WARC/1.0\r\nContent-Length: 9\r\n\r\n", b"a: b\r\nWARC/1.1\r\nc: d\r\n"):
        seconds(unit, 100)
        assert seconds(unit, 80_000) < 24 * max(0.02, seconds(unit, 10_000))


def test_every_undamaged_record_survives():
    rng = random.Random(5)
    parts = members(8)
    starts = [sum(map(len, parts[:i])) for i in range(9)]
    for _ in range(40):
        broken = bytearray(b"".join(parts))
        hit = {rng.randrange(len(broken)) for _ in range(3)}
        for at in hit:
            broken[at] ^= 1 << rng.randrange(8)
        intact = [i for i in range(8) if not any(starts[i] <= h < starts[i + 1] for h in hit)]
        assert set(intact) <= set(ids(bytes(broken)))


def test_empty_table(spark):
    assert warc.read_archives(warc.write_archives(warc.mark_revisits(pages(spark, [(1, "u", "h")]).limit(0)))).count() == 0
    assert warc.read_archives(spark.createDataFrame([("a", None)], "archive string, content binary")).count() == 0


def test_base32(spark):
    texts = ["", "a", "é" * 100]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(warc.base32_sha1(__import__("pyspark").sql.functions.col("t").cast("binary"))).collect()
    assert [r[0] for r in found] == [digest(t.encode()) for t in texts]
