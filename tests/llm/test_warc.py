import base64
import gzip
import hashlib
import time
import zlib

import pytest

from staffline.llm import warc as W
from staffline.llm import common
from staffline.llm.common import shared_folder

from .helpers import executed_with_small_thresholds

DATE = "2000-01-01T00:00:00Z"
PAGES = "page_id long, url string, payload binary, digest int, response_id string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, None if p is None else bytearray(p), 1, "x") for i, u, p in rows], PAGES)


def round_trip(spark, rows, **options):
    folder = shared_folder(spark)
    W.write_archives(spark, pages(spark, rows), folder, **options)
    return W.read_archives(spark, folder).collect()


def test_round_trip(spark):
    long_one = bytes(range(256)) * 4000
    rows = [(1, "http://a/", b"same"), (3, "http://b/\r\nX: y", b"same"), (2, None, b"same"), (4, "u", None), (5, "u", b""), (6, "u", long_one), (None, "n", b"same"), (7, "z", b"\r\n\r\nWARC/1.1\r\n\x1f\x8b\x08")]
    found = round_trip(spark, rows)
    assert all(r.gap is None for r in found) and len(found) == len(rows)
    by_id = {r.record_id: r for r in found}
    for page_id, _, payload in rows:
        r, payload = by_id[W.page_urn(page_id)], payload or b""
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        response = {b"same": 3, b"": 5}.get(payload, page_id)
        assert (r.record_type, r.refers_to) == (("response", None) if page_id == response else ("revisit", W.page_urn(response)))
        assert bytes(r.payload) == (payload if page_id == response else b"")
    assert "\n" not in by_id[W.page_urn(3)].target_uri


def test_small_payloads_are_not_revisited_and_ties_are_responses(spark):
    rows = [(1, "a", b"abc"), (2, "a", b"abc"), (3, "a", b"abcdef"), (4, "a", b"abcdef"), (4, "b", b"abcdef")]
    found = round_trip(spark, rows, least_bytes=4)
    assert sorted((r.record_id, r.record_type) for r in found) == [
        (W.page_urn(1), "response"), (W.page_urn(2), "response"), (W.page_urn(3), "revisit"), (W.page_urn(4), "response"), (W.page_urn(4), "response")]


def test_empty_table(spark):
    assert round_trip(spark, []) == []


def records(n=5):
    return [W.record_bytes(i, f"http://{i}", f"payload {i} ".encode() * (20 * i + 1), None, False, DATE) for i in range(n)]


def packed(record):
    return W.member(record) + b"\0"


def ids(found):
    return [None if f.gap else int(f.fields["warc-record-id"][len("<urn:x-page:") : -1]) for f in found]


@pytest.mark.parametrize("wrap", [packed, bytes])
def test_salvage_after_damage(wrap):
    parts = [wrap(r) for r in records()]
    whole = b"".join(parts)
    assert ids(W.salvage(whole)) == [0, 1, 2, 3, 4]
    starts = [sum(map(len, parts[:i])) for i in range(6)]
    middle = bytearray(whole)
    middle[starts[2] + len(parts[2]) // 2] ^= 0xFF
    found = list(W.salvage(bytes(middle)))
    assert ids(found) == [0, 1, None, 3, 4] and (found[2].start, found[2].end) == (starts[2], starts[3]) and found[2].gap
    assert ids(W.salvage(whole[:-10])) == [0, 1, 2, 3, None]
    assert ids(W.salvage(whole[10:])) == [None, 1, 2, 3, 4]
    noise = b"noise \x1f\x8b\x08 WARC/1.0 " * 3
    found = list(W.salvage(parts[0] + noise + parts[1] + b"\r\n" + parts[2]))
    assert ids(found) == [0, None, 1, None, 2] and found[1].end - found[1].start == len(noise)
    assert ids(W.salvage(b"junk")) == [None] and ids(W.salvage(b"")) == []


def test_every_byte_is_in_a_record_or_a_gap():
    data = bytearray(b"".join([packed(r) if i % 2 else r for i, r in enumerate(records(6))]))
    for at in range(0, len(data), 37):
        damaged = bytearray(data)
        damaged[at] ^= 0x55
        end = 0
        for f in W.salvage(bytes(damaged)):
            assert set(damaged[end : f.start]) <= {0}
            end = f.end
        assert set(damaged[end:]) <= {0}


def test_member_of_a_long_record_is_whole():
    record = W.record_bytes(1, "u", b"a" * (17 << 20), None, False, DATE)
    assert zlib.decompress(W.member(record), 31) == record
    assert ids(W.salvage(packed(record) + packed(records(1)[0]))) == [1, 0]


def test_a_length_may_lie():
    lying = records(2)[1].replace(b"Content-Length: ", b"Content-Length: 9", 2)
    assert ids(W.salvage(lying + records(1)[0])) == [None, 0]


def test_a_member_may_hold_several_records():
    five = records(5)
    data = packed(records(7)[6]) + gzip.compress(b"".join(five)) + packed(records(7)[5])
    found = list(W.salvage(data))
    assert ids(found) == [6, 0, 1, 2, 3, 4, 5] and len({(f.start, f.end) for f in found}) == 3
    hurt = bytearray(b"".join(five))
    hurt[len(five[0]) + len(five[1]) // 2] ^= 0xFF
    found = list(W.salvage(gzip.compress(bytes(hurt) + b"rest")))
    assert ids(found) == [0, None, 2, 3, 4, None] and all(f.gap.startswith("in a member: ") for f in found if f.gap)
    assert ids(W.salvage(gzip.compress(b"no record") + five[0])) == [None, 0]
    assert 0 in ids(W.salvage(gzip.compress(gzip.compress(five[0]))))  # the inner member is found by the search


@pytest.mark.parametrize(
    "part",
    [b"WARC/1.0\r\n", b"WARC/1.0\r\nA: b\r\n", b"WARC/1.0\r\nContent-Length: 9\r\n\r\n", b"\x1f\x8b\x08", b"\0", b"\0x", b"WARC/1.", b"\r\n\r\nWARC/1.0\r\nA"],
)
def test_time_grows_in_proportion(part):
    took = []
    for n in (20_000, 320_000):
        data = part * n + records(1)[0]
        start = time.perf_counter()
        found = list(W.salvage(data))
        took.append(time.perf_counter() - start)
        assert ids(found)[-1] == 0 and len(found) <= 2
    assert took[1] < 40 * took[0] + 1


def test_failed_checks_are_bounded():
    """Nested records that all claim to reach to the same end, with wrong digests: all but a bounded number are passed over unread."""
    heads, tail = [], b"x" * 50_000 + W.END
    inside = tail
    for _ in range(3000):
        head = b"WARC/1.0\r\nWARC-Block-Digest: sha1:WRONG\r\nContent-Length: %d\r\n\r\n" % (len(inside) - len(W.END))
        inside = head + inside
        heads.append(head)
    reader = W.Reader(inside + records(1)[0])
    reader.waste = [10 * len(inside)]
    assert ids(reader.records()) == [None, 0] and reader.waste[0] >= 0
    bomb = gzip.compress(b"\0" * (100 << 20))
    start = time.perf_counter()
    assert ids(W.salvage(bomb * 20 + packed(records(1)[0]))) == [None, 0]
    assert time.perf_counter() - start < 20


def test_a_payload_that_many_pages_share_is_split(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW", 0)
    rows = [(i, "u", b"same " * 300 if i % 2 else b"%d" % i * 50) for i in range(4000)] + [(i, "u", b"%d" % (i % 100) * 60) for i in range(5000, 5400)]
    made = []
    monkeypatch.setattr(W, "written", lambda df, *a: made.append(df), raising=True)
    W.write_archives(spark, pages(spark, rows).repartition(16), shared_folder(spark))
    assert "skew=true" in executed_with_small_thresholds(spark, made[0])
