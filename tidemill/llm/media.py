"""MPEG transport streams: write payloads as streams, parse them, and describe them.

A stream (ISO/IEC 13818-1, single programme) starts with a PAT and a PMT; one
elementary stream of private data follows in PES packets of ``UNIT`` bytes, one
access unit each, with a PTS. Every ``RAP_EVERY``-th unit starts with an adaptation
field that has the random-access indicator and a PCR. Each byte is one 8-bit
sample at ``RATE`` a second, which gives the time stamps.

The parser reads any stream of 188-byte packets: it follows PAT and PMT (checking
their CRC-32), counts continuity errors, duplicates and damaged packets, and puts
the elementary packets together again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tidemill.llm.common import map_rows, staged, texts_of

PACKET, UNIT, RAP_EVERY, RATE, CLOCK, PAD = 188, 16_384, 4, 48_000, 90_000, 64
PMT_PID, ES_PID, PRIVATE_TYPE, PRIVATE_ID = 0x100, 0x101, 0x06, 0xBD
_PTS_BITS = (1 << 33) - 1


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 1 << 31 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 ^ _CRC[c >> 24 ^ b]) & 0xFFFFFFFF
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    """One table section in one packet's payload, pointer field first."""
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    return (b"\0" + head + struct.pack(">I", crc32_mpeg(head))).ljust(PACKET - 4, b"\xff")


def _tables() -> bytes:
    pat = _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
    pmt = _section(2, 1, struct.pack(">HH", 0xE000 | ES_PID, 0xF000) + struct.pack(">BHH", PRIVATE_TYPE, 0xE000 | ES_PID, 0xF000))
    return struct.pack(">BHB", 0x47, 0x4000, 0x10) + pat + struct.pack(">BHB", 0x47, 0x4000 | PMT_PID, 0x10) + pmt


_TABLES = _tables()


def _pts(value: int, mark: int) -> bytes:
    return struct.pack(">BHH", mark << 4 | value >> 29 & 0x0E | 1, value >> 14 & 0xFFFE | 1, value << 1 & 0xFFFE | 1)


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    out, counter = [_TABLES], 0
    for unit, at in enumerate(range(0, len(payload), UNIT)):
        part = payload[at : at + UNIT]
        stamp = at * CLOCK // RATE & _PTS_BITS
        pes = struct.pack(">IHBBB", 0x100 | PRIVATE_ID, len(part) + 8, 0x80, 0x80, 5) + _pts(stamp, 2) + part
        if unit % RAP_EVERY == 0:
            field = struct.pack(">BIH", 0x50, stamp >> 1, (stamp & 1) << 15 | 0x7E00)
        else:
            field = b""
        room = PACKET - 4 - (len(field) + 1 if field else 0)
        if len(pes) < room:  # the only packet of the unit
            field, room = _stuffed(field, PACKET - 4 - len(pes)), len(pes)
        first = bytes([len(field)]) + field if room < PACKET - 4 else b""
        rest = len(pes) - room
        full, tail = divmod(rest, PACKET - 4)
        n = 1 + full + bool(tail)
        packets = np.empty((n, PACKET), np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, ES_PID >> 8, ES_PID & 255
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        if first:
            packets[0, 3] |= 0x20
        packets[0, 4:] = np.frombuffer(first + pes[:room], np.uint8)
        if full:
            packets[1 : 1 + full, 4:] = np.frombuffer(pes, np.uint8, full * (PACKET - 4), room).reshape(full, -1)
        if tail:
            stuff = _stuffed(b"", PACKET - 4 - tail)
            packets[-1, 3] |= 0x20
            packets[-1, 4:] = np.frombuffer(bytes([len(stuff)]) + stuff + pes[len(pes) - tail :], np.uint8)
        out.append(packets.tobytes())
    return b"".join(out)


def _stuffed(field: bytes, size: int) -> bytes:
    """An adaptation field's body such that it takes size bytes with its length byte."""
    return (field or b"\0" * (size > 1)).ljust(size - 1, b"\xff")


@dataclass
class Table:
    """One version of a table: its extension (a programme's number in a PMT), version, and the bodies of its sections by number."""

    extension: int
    version: int
    bodies: dict[int, bytes]

    def content(self) -> bytes:
        return b"".join(self.bodies[k] for k in sorted(self.bodies))


def _tables_of(sections: Iterable[bytes], number: int) -> tuple[list[Table], int]:
    """Every version of every table of this number in the order of their first sections, and how many sections have a wrong CRC or size.

    A section repeated is read once; one marked as not yet valid is passed over. A version that comes
    again after another one is a table of its own, as version numbers wrap around.
    """
    tables: list[Table] = []
    now: dict[int, Table] = {}
    before: set[bytes] = set()
    bad = 0
    for section in sections:
        if section[0] != number:
            continue
        size = (section[1] & 0x0F) << 8 | section[2]
        if size < 9 or len(section) < size + 3 or (section not in before and crc32_mpeg(section[: size + 3])):
            bad += 1
            continue
        before.add(section)
        extension, version, valid = section[3] << 8 | section[4], section[5] >> 1 & 31, section[5] & 1
        if not valid:
            continue
        table = now.get(extension)
        if table is None or table.version != version:
            table = now[extension] = Table(extension, version, {})
            tables.append(table)
        table.bodies.setdefault(section[6], section[8 : size - 1])
    return tables, bad


def _packets(stream: bytes) -> tuple[np.ndarray, int]:
    """A stream's packets as rows, and how often the sync was lost.

    Where a sync byte is missing, the next packet's place is tried; if that fails too, bytes are
    passed over up to one from which three packets (or all that are left) begin with a sync byte.
    Such places are found once for the whole stream, so the time is linear however often sync is lost.
    """
    n = len(stream)
    grid = np.frombuffer(stream, np.uint8, n // PACKET * PACKET).reshape(-1, PACKET)
    if (grid[:, 0] == 0x47).all():
        return grid, int(n % PACKET > 0)
    data = np.frombuffer(stream, np.uint8)
    last = n - PACKET + 1
    sync = np.ones(last + 2 * PACKET, bool)  # what would begin after the last whole packet doesn't count against a place
    sync[:last] = data[:last] == 0x47
    holds = sync[:last] & sync[PACKET : last + PACKET] & sync[2 * PACKET :]
    places = np.flatnonzero(holds)
    starts, lost, at, locked = [], 0, 0, False
    while at < last:
        if sync[at] and (locked or holds[at]):
            starts.append(at)
            at, locked = at + PACKET, True
            continue
        lost += 1
        if locked and at + PACKET < last and holds[at + PACKET]:
            at += PACKET
            continue
        i = int(np.searchsorted(places, at + 1))
        at = int(places[i]) if i < len(places) else n
    return data[np.array(starts, np.int64)[:, None] + np.arange(PACKET)], lost + (at < n)


def demux(stream: bytes) -> dict:
    """Parsed stream: programmes (number, PMT pid), streams (pid, type), payload by pid, units (pid, pts, offset, size, random access), counts of faults.

    Bytes after the last whole packet, places where the sync is lost and packets with
    the error indicator count as damaged and are passed over. Tables may span packets, have several sections and change their
    version; programmes may share a PMT pid. All streams that any valid version lists are read, each over the whole stream and once.
    """
    grid, damaged = _packets(stream)
    whole = len(grid)
    good = grid[:, 1] & 0x80 == 0
    damaged += int(whole - good.sum())
    grid = grid[good]
    pid = (grid[:, 1].astype(np.int64) & 0x1F) << 8 | grid[:, 2]
    begins = grid[:, 1] & 0x40 > 0
    has_field, has_data = grid[:, 3] & 0x20 > 0, grid[:, 3] & 0x10 > 0
    start = 4 + np.where(has_field, 1 + grid[:, 4].astype(np.int64), 0)
    damaged += int((start > PACKET).sum())
    start = np.where(has_data, np.minimum(start, PACKET), PACKET)
    flags = np.where(has_field & (grid[:, 4] > 0), grid[:, 5], 0)
    counter = grid[:, 3] & 15
    found: dict = {"programmes": [], "streams": [], "payload": {}, "units": [], "packets": int(whole), "damaged": damaged, "continuity_errors": 0, "duplicates": 0, "bad_tables": 0}

    def sections(p: int) -> Iterator[bytes]:
        """Whole sections of a pid, put together over packets."""
        open_, before = b"", None
        for i in np.flatnonzero((pid == p) & has_data):
            if before is not None and (grid[i] == grid[before]).all():
                continue  # sent twice
            before = i
            data = grid[i, start[i] :].tobytes()
            if begins[i]:
                to = data[0] + 1 if data else 0
                ended, rest = open_ + data[1:to] if open_ else b"", data[to:]
                if len(ended) >= 3:
                    yield ended
                open_ = rest
            elif open_:
                open_ += data
            while len(open_) >= 3 and open_[0] != 0xFF and len(open_) >= (size := ((open_[1] & 0x0F) << 8 | open_[2]) + 3):
                yield open_[:size]
                open_ = open_[size:]
            if open_[:1] == b"\xff":
                open_ = b""

    def tables(p: int, number: int) -> list[Table]:
        out, bad = _tables_of(sections(p), number)
        found["bad_tables"] += bad
        return out

    programmes: dict[tuple[int, int], None] = {}  # numbers and PMT pids, in order
    for pat in tables(0, 0):
        body = pat.content()
        for i in range(0, len(body) - 3, 4):
            number, map_pid = struct.unpack_from(">HH", body, i)
            if number:
                programmes[number, map_pid & 0x1FFF] = None
    maps = {p: tables(p, 2) for p in dict.fromkeys(p for _, p in programmes)}
    streams: dict[tuple[int, int], None] = {}
    for number, p in programmes:
        for pmt in (t.content() for t in maps[p] if t.extension == number):
            at = 4 + (struct.unpack_from(">H", pmt, 2)[0] & 0xFFF) if len(pmt) >= 4 else len(pmt)
            while at + 5 <= len(pmt):
                kind, es, info = struct.unpack_from(">BHH", pmt, at)
                streams[es & 0x1FFF, kind] = None
                at += 5 + (info & 0xFFF)
    found["programmes"], found["streams"] = list(programmes), list(streams)
    for es in dict.fromkeys(p for p, _ in streams):
        own = np.flatnonzero((pid == es) & has_data)
        if len(own) > 1:
            step = (counter[own][1:].astype(np.int64) - counter[own][:-1]) & 15
            same = np.append(False, (step == 0) & (grid[own][1:] == grid[own][:-1]).all(1))
            found["duplicates"] += int(same.sum())
            jump = flags[own][1:] & 0x80 > 0
            found["continuity_errors"] += int(((step != 1) & ~same[1:] & ~jump).sum())
            own = own[~same]
        body, at = grid[own], start[own]
        data = body[np.arange(PACKET) >= at[:, None]]
        sizes = PACKET - at
        ends = np.cumsum(sizes)
        heads = np.flatnonzero(begins[own])
        parts, offset = [], 0
        for j, h in enumerate(heads):
            a = int(ends[h] - sizes[h])
            b = int(ends[heads[j + 1]] - sizes[heads[j + 1]]) if j + 1 < len(heads) else len(data)
            pes = data[a:b].tobytes()
            if len(pes) < 9 or pes[:3] != b"\0\0\1":
                found["damaged"] += 1
                continue
            length = struct.unpack_from(">H", pes, 4)[0]
            if length and len(pes) < length + 6:
                found["damaged"] += 1
            pes = pes[: length + 6] if length else pes
            pts = None
            if pes[7] & 0x80 and len(pes) >= 14:
                x, y, z = struct.unpack_from(">BHH", pes, 9)
                pts = (x & 0x0E) << 29 | (y & 0xFFFE) << 14 | z >> 1
            part = pes[9 + pes[8] :]
            found["units"].append((es, pts, offset, len(part), bool(flags[own[h]] & 0x40)))
            offset += len(part)
            parts.append(part)
        found["payload"][es] = b"".join(parts)
    return found


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and them with zeros up to a positive multiple of PAD."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw.ljust(max(PAD, -(-len(raw) // PAD) * PAD), b"\0")


def feature(found: dict) -> str:
    """What a stream holds, in one line: tables, faults, time stamps and random-access points."""
    units = found["units"]
    stamps, points = [u[1] for u in units if u[1] is not None], [u for u in units if u[4]]
    shown = zlib.crc32(b"".join(struct.pack("<qq", -1 if u[1] is None else u[1], u[2]) for u in points))
    return (
        f"streams={','.join(f'{p:#x}:{k:#x}' for p, k in found['streams'])};packets={found['packets']};units={len(units)};"
        f"continuity_errors={found['continuity_errors']};duplicates={found['duplicates']};damaged={found['damaged']};bad_tables={found['bad_tables']};"
        f"first_pts={min(stamps, default=-1)};last_pts={max(stamps, default=-1)};random_access={len(points)};index_crc32={shown:08x}"
    )


def _store():
    def rows(docs: Iterable[tuple]) -> Iterator[tuple]:
        for doc_id, text in docs:
            n, payload = padded(text)
            yield doc_id, n, mux(payload)

    return rows


def store_streams(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the text's bytes, padded, as a transport stream), staged in the shared folder.

    A null text is empty (64 zero bytes); a null doc_id stays null; repeated
    rows are stored each; a very long text is one stream, made in memory. An empty table gives no rows. Other columns are left behind. No shuffle.
    """
    return staged(map_rows(texts_of(docs), _store, "doc_id long, n_bytes long, media binary"), "media")


def _describe(with_units: bool):
    def rows(stored: Iterable[tuple]) -> Iterator[tuple]:
        for doc_id, n, media in stored:
            found = demux(media)
            data = b"".join(found["payload"].values())
            units = [(p, -1 if s is None else s, o, z, r) for p, s, o, z, r in found["units"]] if with_units else []
            yield doc_id, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature(found), [dict(zip(("pid", "pts", "offset", "size", "random_access"), u)) for u in units]

    return rows


def describe_streams(stored: DataFrame, with_units: bool = True) -> DataFrame:
    """One row per stored stream: digests of what was read back, its features, and its access units with time stamps (-1: none) and random-access marks.

    with_units=False leaves the list of units empty. A stream that can't be read has no units and no payload. An empty table gives no rows.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, units array<struct<pid:int,pts:long,offset:long,size:long,random_access:boolean>>"
    return map_rows(stored.select("doc_id", "n_bytes", "media"), _describe, schema, with_units)
