import hashlib
import random
import zlib

from tidemill.llm.media import PACKET, UNIT, crc32_mpeg, demux, describe_streams, mux, padded, store_streams


def test_streams_round_trip():
    assert crc32_mpeg(b"123456789") == 0x0376E6E7
    rnd = random.Random(3)
    for n in (0, 1, 64, 65, 150, 162, 163, 170, 178, 184, 188, 5000, UNIT - 1, UNIT, UNIT + 1, UNIT + 170, 5 * UNIT + 7):
        data = rnd.randbytes(n)
        ts = mux(data)
        got = demux(ts)
        assert len(ts) % PACKET == 0 and b"".join(got["payload"].values()) == data, n
        assert got["continuity_errors"] == got["damaged"] == got["duplicates"] == got["bad_tables"] == 0
        assert [u[1] for u in got["units"]] == [k * UNIT * 90_000 // 48_000 for k in range(-(-n // UNIT))]
        assert [u[4] for u in got["units"]] == [k % 4 == 0 for k in range(-(-n // UNIT))]


def test_faults_are_found():
    ts = mux(bytes(range(256)) * 40)
    cut = ts[: 188 * 5] + ts[188 * 6 :]
    assert demux(cut)["continuity_errors"] == 1
    assert demux(ts[: 188 * 5] + ts[188 * 4 :])["duplicates"] == 1
    assert demux(ts[: 188 * 5] + b"\0" + ts[188 * 5 + 1 :])["damaged"] >= 1
    assert demux(ts[:30] + b"x" + ts[31:])["streams"] == [(0x101, 6)]  # stuffing after the table
    assert demux(ts[:10] + b"\xee" + ts[11:])["bad_tables"] == 1
    assert demux(b"")["packets"] == 0


def _packet(pid, data, counter, begins=False, field=None):
    """A packet made by hand: the header, an adaptation field (or stuffing) and data."""
    head = bytes([0x47, (0x40 if begins else 0) | pid >> 8, pid & 255])
    room = 184 - len(data)
    if field is None and not room:
        return head + bytes([0x10 | counter]) + data
    body = (field or b"\0").ljust(room - 1, b"\xff") if room > 1 else b""
    return head + bytes([0x30 | counter, room - 1]) + body + data


def _section(table, extension, body, number=0, last=0, version=0, valid=1):
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255]) + extension.to_bytes(2, "big") + bytes([0xC0 | version << 1 | valid, number, last])
    crc = crc32_mpeg(head + body)
    return head + body + crc.to_bytes(4, "big")


def _hand_made(n_streams):
    """A stream whose programme map has many elementary streams, over two packets, with one unit in the last of them."""
    pat = _packet(0, b"\0" + _section(0, 1, bytes([0, 1, 0xE1, 0x00])), 0, True)
    body = bytes([0xE1, 0x40, 0xF0, 0x00]) + b"".join(bytes([6, 0xE0 | (0x140 + i) >> 8, (0x140 + i) & 255, 0xF0, 0]) for i in range(n_streams))
    pmt = b"\0" + _section(2, 1, body)
    maps = [_packet(0x100, pmt[i : i + 184], i // 184, i == 0) for i in range(0, len(pmt), 184)]
    pts = 123_456_789
    stamp = bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, pts >> 14 & 0xFE | 1, pts >> 7 & 255, pts << 1 & 0xFE | 1])
    pes = b"\0\0\1\xbd" + (8 + 50).to_bytes(2, "big") + b"\x80\x80\x05" + stamp + b"z" * 50
    return pat + b"".join(maps) + _packet(0x140 + n_streams - 1, pes, 0, True, b"\x40") + _packet(0x140, b"", 0, field=b"\0") * 2, maps


def test_packets_made_by_hand():
    for n in (1, 30, 40, 90):
        ts, maps = _hand_made(n)
        assert len(ts) % PACKET == 0 and (len(maps) > 1) == (n > 30)
        got = demux(ts)
        assert got["streams"] == [(0x140 + i, 6) for i in range(n)] and got["bad_tables"] == got["damaged"] == 0
        assert got["units"] == [(0x140 + n - 1, 123_456_789, 0, 50, True)] and got["payload"][0x140 + n - 1] == b"z" * 50


def _map(programme, pids, **how):
    """A PMT's section that lists these pids as private data."""
    return _section(2, programme, bytes([0xE1, 0x40, 0xF0, 0]) + b"".join(bytes([6, 0xE0 | p >> 8, p & 255, 0xF0, 0]) for p in pids), **how)


def _unit(pid, content, counter=0):
    return _packet(pid, b"\0\0\1\xbd" + (3 + len(content)).to_bytes(2, "big") + b"\x80\0\0" + content, counter, True)


def test_versions_of_tables():
    pat = _packet(0, b"\0" + _section(0, 1, bytes([0, 1, 0xE1, 0])), 0, True)
    maps = [_packet(0x100, b"\0" + _map(1, pids, version=v, valid=valid), i, True) for i, (pids, v, valid) in enumerate([((0x140,), 31, 1), ((0x150,), 0, 0), ((0x141, 0x140), 0, 1), ((0x142,), 31, 1)])]
    units = [_unit(0x140, b"a"), _unit(0x141, b"b"), _unit(0x142, b"c"), _unit(0x150, b"d")]
    got = demux(pat + maps[0] + units[0] + maps[1] + maps[2] + units[1] + maps[3] + units[2] + units[3])
    assert got["streams"] == [(0x140, 6), (0x141, 6), (0x142, 6)] and got["bad_tables"] == 0
    assert got["payload"] == {0x140: b"a", 0x141: b"b", 0x142: b"c"} and len(got["units"]) == 3  # 0x150 was not yet valid


def test_programmes_on_one_pid():
    pat = _packet(0, b"\0" + _section(0, 1, bytes([0, 1, 0xE1, 0, 0, 2, 0xE1, 0, 0, 3, 0xE1, 0x01])), 0, True)
    both = _packet(0x100, b"\0" + _map(1, [0x140]) + _map(2, [0x141, 0x140]) + _map(9, [0x149]), 0, True)
    got = demux(pat + both + _packet(0x101, b"\0" + _map(3, [0x142]), 0, True) + b"".join(_unit(0x140 + i, bytes([i + 1])) for i in range(3)))
    assert got["programmes"] == [(1, 0x100), (2, 0x100), (3, 0x101)] and got["bad_tables"] == 0
    assert got["streams"] == [(0x140, 6), (0x141, 6), (0x142, 6)] and got["payload"] == {0x140: b"\1", 0x141: b"\2", 0x142: b"\3"}


def test_sync_lost_often():
    data = random.Random(7).randbytes(4 << 20)
    ts = mux(data)
    pieces = [ts[i : i + 4 * PACKET] for i in range(0, len(ts), 4 * PACKET)]
    got = demux(b"\0".join(pieces))
    assert b"".join(got["payload"].values()) == data and got["damaged"] == len(pieces) - 1 and got["continuity_errors"] == 0


def test_sync_is_found_again():
    data = random.Random(5).randbytes(20_000)
    ts = mux(data)
    whole = demux(ts)
    for stray in (b"\0", b"G", b"\0" * 100):
        got = demux(stray + ts)
        assert got["units"] == whole["units"] and got["payload"] == whole["payload"] and got["damaged"] >= 1
    inside = demux(ts[: PACKET * 40] + b"stray" + ts[PACKET * 40 :])
    assert b"".join(inside["payload"].values()) == data and inside["damaged"] == 1 and inside["continuity_errors"] == 0


def test_streams_of_documents(odd_docs, empty_docs):
    rows = describe_streams(store_streams(odd_docs)).collect()
    texts = sorted((r.doc_id is not None, r.doc_id, r.text or "") for r in odd_docs.collect())
    for (_, doc_id, text), r in zip(texts, sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id))):
        n, data = padded(text)
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (doc_id, n, len(data))
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-64:])
        assert r.media_sha256 == hashlib.sha256(mux(data)).hexdigest() and sum(u.size for u in r.units) == len(data)
    assert len(rows) == len(texts)
    assert describe_streams(store_streams(empty_docs)).count() == 0
