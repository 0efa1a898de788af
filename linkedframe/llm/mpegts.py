"""Media columns: bytes stored as MPEG transport streams, and streams read back with their timing.

A stream starts with one program association table and one program map table and carries one private stream.  The
payload is cut into access units of ``UNIT`` bytes, each an elementary packet with a presentation time stamp.  The
first transport packet of each unit has the program clock, and every ``GROUP``-th unit is a random-access point.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

from pyspark.sql import DataFrame

from linkedframe.llm.common import with_text_columns

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, NO_PID = 0, 0x100, 0x101, 0x1FFF
PRIVATE_STREAM, STREAM_TYPE = 0xBD, 0x06
UNIT, GROUP, CLOCK = 4096, 8, 3600
#: Stream ids of elementary packets that have no header fields, and of padding.
BARE, PADDING = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)), 0xBE


def mpeg_crc(data: bytes) -> int:
    """CRC-32 of table sections: most significant bit first, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", mpeg_crc(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(PAT_PID, _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))) + _table_packet(
    PMT_PID, _section(2, 1, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, STREAM_TYPE, 0xE000 | DATA_PID, 0xF000))
)
_HEADS = {(first, control): [struct.pack(">BHB", SYNC, first << 14 | DATA_PID, control << 4 | c) for c in range(16)] for first in (0, 1) for control in (1, 3)}


def _time(pts: int) -> bytes:
    return bytes((0x21 | pts >> 29 & 14, pts >> 22 & 255, 1 | pts >> 14 & 254, pts >> 7 & 255, 1 | pts << 1 & 254))


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, counter = [TABLES], 0
    for k, start in enumerate(range(0, len(payload), UNIT)):
        unit = payload[start : start + UNIT]
        pts = k * CLOCK & 0x1FFFFFFFF
        pes = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(unit) + 8, 0x80, 0x80, 5) + _time(pts) + unit
        clock = bytes((0x50 if k % GROUP == 0 else 0x10, pts >> 25 & 255, pts >> 17 & 255, pts >> 9 & 255, pts >> 1 & 255, (pts & 1) << 7 | 0x7E, 0))
        room = PACKET - 4 - 8
        part = pes[:room]
        out += _HEADS[1, 3][counter], bytes((7 + room - len(part),)), clock, b"\xff" * (room - len(part)), part
        counter = counter + 1 & 15
        at = room
        while at < len(pes):
            part = pes[at : at + 184]
            if len(part) == 184:
                out += _HEADS[0, 1][counter], part
            else:
                gap = 183 - len(part)
                out += _HEADS[0, 3][counter], bytes((gap,)), (b"\0" + b"\xff" * (gap - 1) if gap else b""), part
            counter = counter + 1 & 15
            at += 184
    return b"".join(out)


def _pts(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


class _Sections:
    """Table sections of one PID, put together over packets."""

    def __init__(self):
        self.held, self.errors = b"", 0

    def add(self, body: bytes, first: bool) -> list[bytes]:
        """The whole sections that a packet ends; their checksums hold."""
        if not first:
            self.held += body
            return self._whole() if self.held else []
        at = 1 + body[0] if body else 0
        self.held = self.held + body[1:at] if self.held else b""
        found = self._whole()
        self.errors += bool(self.held)
        self.held = body[at:]
        return found + self._whole()

    def _whole(self) -> list[bytes]:
        found = []
        while len(self.held) >= 3 and self.held[0] != 0xFF:
            size = 3 + (int.from_bytes(self.held[1:3]) & 0xFFF)
            if len(self.held) < size:
                return found
            section, self.held = self.held[:size], self.held[size:]
            if size < 12 or mpeg_crc(section):
                self.errors += 1
            else:
                found.append(section)
        if self.held[:1] == b"\xff":
            self.held = b""  # stuffing
        return found


class _Stream:
    """One elementary stream: its packets are put together, and closed by their length or by the next one's start."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.size, self.want = kind, [], 0, 0
        self.payload: list[bytes] = []
        self.pts: list[int] = []
        self.access: list[int] = []
        self.units: list[dict] = []
        self.begun: tuple[int, bool] = (0, False)

    def add(self, body: bytes, first: bool, at: int, access: bool) -> None:
        """The bytes of the transport packet at an offset, which may be flagged for random access."""
        if access:
            self.access.append(at)
        if first:
            self.close()
            if body[:3] != b"\0\0\1" or len(body) < 6:
                return
            self.begun = at, access
            length = int.from_bytes(body[4:6])
            self.want = 6 + length if length else 1 << 62
        elif not self.want:
            return  # behind the end of its packet, or its start is lost
        self.parts.append(body)
        self.size += len(body)
        if self.size >= self.want:
            self.close()

    def close(self) -> None:
        packet = b"".join(self.parts)[: self.want] if self.want < 1 << 62 else b"".join(self.parts)
        self.parts, self.size, self.want = [], 0, 0
        if len(packet) >= 9 and packet[3] not in BARE:
            pts = _pts(packet[9:14]) if packet[7] & 0x80 and len(packet) >= 14 else None
            if pts is not None:
                self.pts.append(pts)
            self._keep(packet[9 + packet[8] :], pts)
        elif len(packet) > 6 and packet[3] != PADDING:
            self._keep(packet[6:], None)

    def _keep(self, data: bytes, pts: int | None) -> None:
        self.payload.append(data)
        self.units.append({"at": self.begun[0], "pts": pts, "access": self.begun[1], "size": len(data)})


def demux(media: bytes) -> dict:
    """What a stream holds: its programs, elementary streams with payload, time stamps and access points, and faults.

    ``streams`` are in the order of the program tables, each with PID, type, payload, ``pts`` (of each elementary packet
    that has one), ``access``, the byte offset of each transport packet flagged for random access, and ``units``: of each
    elementary packet the offset of the transport packet it begins in, its time stamp or null, whether that transport
    packet is flagged, and how many bytes it adds to the payload.  So a reader seeks by time and by place in the payload.
    ``continuity_errors`` are packets whose counter does not follow, unless they are the one before, sent twice;
    ``table_errors`` sections that are cut or have a wrong checksum; ``sync_errors`` the bytes skipped to find a packet,
    which starts with the sync byte and has another one behind it.  A lost packet leaves a gap in the payload.
    Left out of the payload and counted: ``damaged`` packets, marked so by the transport; ``scrambled`` ones; and
    ``unmapped`` ones, of a PID that no table has named so far.  Tables that hold only from later on are passed over.
    """
    programs: dict[int, int] = {}
    streams: dict[int, _Stream] = {}
    tables: dict[int, _Sections] = {PAT_PID: _Sections()}
    counters: dict[int, int] = {}
    before: dict[int, bytes] = {}
    continuity = sync = packets = damaged = scrambled = unmapped = 0
    at, end = 0, len(media)
    while at + PACKET <= end:
        if media[at] != SYNC or at + PACKET < end and media[at + PACKET] != SYNC and sync_lost(media, at):
            found = media.find(b"\x47", at + 1)
            while 0 <= found and found + PACKET <= end and found + PACKET < end and media[found + PACKET] != SYNC:
                found = media.find(b"\x47", found + 1)
            found = end if found < 0 else found
            sync, at = sync + found - at, found
            continue
        packet = media[at : at + PACKET]
        pid, control, first = (packet[1] & 0x1F) << 8 | packet[2], packet[3], bool(packet[1] & 0x40)
        start, packets, flags = 4, packets + 1, 0
        if packet[1] & 0x80:
            damaged += 1
            at += PACKET
            continue
        if control & 0x20:
            flags = packet[5] if packet[4] else 0
            start += 1 + packet[4]
        if control & 0x10 and start <= PACKET:
            last = counters.get(pid)
            counters[pid] = control & 15
            if last is not None and control & 15 != last + 1 & 15 and not flags & 0x80:
                if control & 15 == last and packet == before.get(pid):
                    at += PACKET
                    continue
                continuity += 1
            before[pid] = packet
            if control & 0xC0:
                scrambled += 1
            elif pid in streams:
                streams[pid].add(packet[start:], first, at, bool(flags & 0x40))
            elif pid in tables:
                for section in tables[pid].add(packet[start:], first):
                    _read_table(pid, section, programs, tables, streams)
            elif pid != NO_PID:
                unmapped += 1
        at += PACKET
    for stream in streams.values():
        stream.close()
    return {
        "streams": [{"pid": pid, "type": x.kind, "payload": b"".join(x.payload), "pts": x.pts, "access": x.access, "units": x.units} for pid, x in streams.items()],
        "n_packets": packets,
        "n_programs": len(programs),
        "n_streams": len(streams),
        "continuity_errors": continuity,
        "table_errors": sum(t.errors + bool(t.held) for t in tables.values()),
        "sync_errors": sync + end - at,
        "damaged": damaged,
        "scrambled": scrambled,
        "unmapped": unmapped,
    }


def sync_lost(media: bytes, at: int) -> bool:
    """Whether what follows a packet is not in step either way: one damaged sync byte does not part a stream."""
    return at + 2 * PACKET >= len(media) or media[at + 2 * PACKET] != SYNC


def _read_table(pid: int, section: bytes, programs: dict[int, int], tables: dict[int, _Sections], streams: dict[int, _Stream]) -> None:
    """Programs from an association table, streams from a program's map."""
    end = len(section) - 4
    if not section[5] & 1:
        return
    if pid == PAT_PID:
        for i in range(8, end - 3, 4):
            number, target = struct.unpack_from(">HH", section, i)
            if number:
                programs[number] = target & 0x1FFF
                tables.setdefault(target & 0x1FFF, _Sections())
        return
    i = 12 + (int.from_bytes(section[10:12]) & 0xFFF)
    while section[0] == 2 and i + 5 <= end:
        streams.setdefault(int.from_bytes(section[i + 1 : i + 3]) & 0x1FFF, _Stream(section[i]))
        i += 5 + (int.from_bytes(section[i + 3 : i + 5]) & 0xFFF)


def pad(data: bytes, block: int = 64) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of ``block``."""
    return data.ljust(max(1, -(-len(data) // block)) * block, b"\0")


def store_texts(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with ``n_bytes`` (of the UTF-8 text) and ``media``, its padded bytes as a transport stream.

    A null text counts as empty and gives a stream of one block of zeros.  Rows are independent; repeated rows repeat,
    an empty table stays empty, columns of the new names are replaced, and any length goes whole.
    """

    def make():
        def function(texts):
            raw = [x.encode() for x in texts]
            return [len(x) for x in raw], [mux(pad(x)) for x in raw]

        return function

    return with_text_columns(docs, [("n_bytes", "long"), ("media", "binary")], make, text, keep)


READ = [
    ("streams", "array<struct<pid:int,type:int,payload:binary,pts:array<long>,access:array<long>,units:array<struct<at:long,pts:long,access:boolean,size:long>>>>"),
    ("n_packets", "long"),
    ("n_programs", "long"),
    ("n_streams", "long"),
    ("continuity_errors", "long"),
    ("table_errors", "long"),
    ("sync_errors", "long"),
    ("damaged", "long"),
    ("scrambled", "long"),
    ("unmapped", "long"),
]


def read_media(media: DataFrame, column: str = "media", keep: Sequence[str] | None = None) -> DataFrame:
    """A table of streams with what :func:`demux` finds in each.  A null stream reads as one without packets."""

    def make():
        def function(streams):
            found = [demux(x or b"") for x in streams]
            return [[x[name] for x in found] for name, _ in READ]

        return function

    return with_text_columns(media, READ, make, column, keep)
