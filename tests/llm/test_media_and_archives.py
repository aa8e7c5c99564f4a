import base64
import hashlib
import io
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlspar.llm import transport as ts
from marlspar.llm import warc


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 700), st.integers(0, 255))
def test_streams_round_trip(n, seed):
    payload = ts.pad(bytes((seed * i + i // 7) % 256 for i in range(n)))
    stream = ts.mux(payload)
    assert len(stream) % ts.PACKET == 0 and ts.demux(stream)[0] == payload
    assert ts.mux(payload) == stream


@pytest.mark.parametrize("n", [ts.UNIT - 64, ts.UNIT, ts.UNIT + 64, 20 * ts.UNIT + 128])
def test_long_streams_have_timestamps_and_random_access_points(n):
    payload, index = ts.demux(ts.mux(bytes(n)))
    assert payload == bytes(n)
    assert [x[0] for x in index] == [k * ts.TICKS for k in range(len(index))]
    assert [x[3] for x in index] == [k % ts.RANDOM_EVERY == 0 for k in range(len(index))]
    assert [x[2] for x in index] == list(range(0, n, ts.UNIT))


def test_damage_is_noticed():
    stream = ts.mux(bytes(range(256)) * 8)
    p = ts.PACKET
    for bad in (b"", stream[:-1], stream[: 3 * p] + stream[4 * p :], b"\x00" + stream[1:], stream[:10] + b"\xee" + stream[11:], stream[: 2 * p], stream[p:], stream[: 2 * p] + stream[3 * p :]):
        with pytest.raises(ts.StreamError):
            ts.demux(bad)


def packets(stream):
    return [stream[i : i + ts.PACKET] for i in range(0, len(stream), ts.PACKET)]


def test_every_table_is_read():
    """Five random-access points, so five PATs and PMTs; damage in any of them is noticed."""
    stream = packets(ts.mux(bytes(5 * ts.RANDOM_EVERY * ts.UNIT)))
    for pid in (ts.PAT_PID, ts.PMT_PID):
        where = [i for i, x in enumerate(stream) if (x[1] & 0x1F) << 8 | x[2] == pid]
        assert len(where) == 5
        for i in where:
            bad = stream[i][:15] + bytes([stream[i][15] ^ 1]) + stream[i][16:]
            with pytest.raises(ts.StreamError):
                ts.demux(b"".join([*stream[:i], bad, *stream[i + 1 :]]))


def section_packets(pid, section):
    """A section over as many packets as it takes, counted from 0."""
    data, out = b"\0" + section, []
    for k, at in enumerate(range(0, len(data), ts.BODY)):
        head = bytes([ts.SYNC, (0x40 if not k else 0) | pid >> 8, pid & 0xFF, 0x10 | k & 15])
        out.append(head + data[at : at + ts.BODY].ljust(ts.BODY, b"\xff"))
    return out


def test_streams_of_other_muxers():
    payload = ts.pad(bytes(i * 7 % 251 for i in range(5000)))
    stream = packets(ts.mux(payload))
    body = [x for x in stream if (x[1] & 0x1F) << 8 | x[2] == ts.DATA_PID]
    network = (0).to_bytes(2, "big") + (0xE010).to_bytes(2, "big")
    programs = b"".join(n.to_bytes(2, "big") + (0xE000 | (ts.PMT_PID if n == 1 else 0x300 + n)).to_bytes(2, "big") for n in range(1, 80))
    about = bytes([5, 4]) + b"TEXT"
    video = bytes([0x1B]) + (0xE200).to_bytes(2, "big") + (0xF000 | len(about)).to_bytes(2, "big") + about
    ours = bytes([ts.STREAM_TYPE]) + (0xE000 | ts.DATA_PID).to_bytes(2, "big") + (0xF000 | len(about)).to_bytes(2, "big") + about
    pmt = (0xE100).to_bytes(2, "big") + (0xF000 | len(about)).to_bytes(2, "big") + about + video + ours
    pat = section_packets(ts.PAT_PID, ts._section(0, 1, network + programs))
    assert len(pat) == 2
    empty = bytes([ts.SYNC, ts.DATA_PID >> 8, ts.DATA_PID & 0xFF, 0x20 | body[0][3] & 15, 183, 0]).ljust(ts.PACKET, b"\xff")
    other = bytes([ts.SYNC, 0x42, 0, 0x17]).ljust(ts.PACKET, b"\x01")
    mixed = [*pat, *section_packets(ts.PMT_PID, ts._section(2, 1, pmt)), body[0], empty, other, body[1], body[1], *body[2:]]
    assert ts.demux(b"".join(mixed))[0] == payload
    with pytest.raises(ts.StreamError):
        ts.demux(b"".join([*mixed[:4], body[0], *mixed[4:7], body[1], *mixed[7:]]))  # a packet three times


def test_section_crc_is_the_standard_one():
    assert ts.section_crc(b"123456789") == 0x0376E6E7


def test_media_of_awkward_rows(documents, awkward):
    media, _ = ts.store_media(documents(awkward, extra=True))
    rows = ts.media_features(media).collect()
    want = []
    for i, text, *_ in awkward:
        raw = (text or "").encode()
        payload = ts.pad(raw)
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(ts.mux(payload)).hexdigest()))
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_sha256"]) for r in rows), key=str) == sorted(want, key=str)
    same = [r for r in rows if r["doc_id"] in (5, 6)]
    assert len({r["feature"] for r in same}) == 1
    assert ts.media_features(ts.store_media(documents([]))[0]).count() == 0


def test_records_are_framed_and_verified():
    good = warc.build_record(1, "http://a/", b"payload") + warc.build_record(2, None, b"", refers_to=1)
    records = list(warc.iter_records(io.BytesIO(good)))
    assert [r[0]["warc-type"] for r in records] == ["response", "revisit"] and records[0][2] == b"payload"
    assert records[1][0]["warc-refers-to"] == "<urn:page:1>"
    with pytest.raises(ValueError):
        list(warc.iter_records(io.BytesIO(good[:-5])))
    raw = zlib.decompress(warc.build_record(1, "http://a/", b"payload"), 31)
    for bad in (raw.replace(b"payload\r\n", b"paylaod\r\n"), raw.replace(b"Content-Length: 7", b"Content-Length: 9"), raw[:-4], raw[4:]):
        with pytest.raises(ValueError):
            list(warc.iter_records(io.BytesIO(zlib.compress(bad, wbits=31))))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=3000), max_size=5), st.integers(1, 700))
def test_members_in_any_chunks(contents, chunk):
    data = b"".join(zlib.compress(c, wbits=31) for c in contents)
    assert list(warc.iter_members(io.BytesIO(data), chunk)) == contents


def test_archives_of_awkward_pages(spark):
    from pyspark.sql import functions as F

    rows = [(5, "http://a/\r\nX: y", "same"), (3, None, "same"), (9, "u", "same"), (2, "u", None), (4, "u", ""), (None, "u", "same"), (7, "u", "é中" * 90_000), (3, "u", "same"), (11, "u", "own\r\n\r\nbody")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("digest", "n", "refers_to", "path")})
    manifest, _ = warc.write_archives(pages, file_bytes=400)
    got = sorted(map(tuple, warc.read_archives(manifest).collect()), key=str)
    least = {"same": 3, "": 2}
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        first = least.get(html or "")
        revisit = page is not None and first is not None and page != first
        want.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    payloads = {r["page_id"]: r["payload"] for r in warc.read_archives(manifest, with_payload=True).collect() if r["record_type"] == "response"}
    assert payloads[7] == "é中" * 90_000 and payloads[11] == "own\r\n\r\nbody"
    assert sum(r[3] == "revisit" for r in warc.read_archives(warc.write_archives(pages, least_bytes=5)[0]).collect()) == 0
    assert warc.read_archives(warc.write_archives(pages.limit(0))[0]).count() == 0


def test_http_length_must_be_the_payload_s():
    import gzip

    plain = gzip.decompress(warc.build_record(1, "http://a/", b"payload"))
    head, _, rest = plain.partition(b"\r\n\r\n")
    block = rest[:-4].replace(b"Content-Length: 7", b"Content-Length: 8")
    old = next(x for x in head.split(b"\r\n") if x.startswith(b"WARC-Block-Digest"))
    bad = head.replace(old, b"WARC-Block-Digest: sha1:" + warc.base32_sha1(block).encode()) + b"\r\n\r\n" + block + b"\r\n\r\n"
    with pytest.raises(ValueError, match="HTTP content-length"):
        list(warc.iter_records(io.BytesIO(gzip.compress(bad))))
    assert next(warc.iter_records(io.BytesIO(gzip.compress(plain))))[2] == b"payload"
