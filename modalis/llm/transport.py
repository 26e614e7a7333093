"""Media columns: MPEG transport streams (ISO/IEC 13818-1).

:func:`mux` stores a payload losslessly as one private elementary stream: a program association table
and a program map table ahead of every random-access point, the payload in PES packets with a 90 kHz
presentation time and a program clock reference each, continuity counters and adaptation-field stuffing.
:func:`demux` parses any such stream: it puts tables together from sections that may span packets or share
one, follows them to the elementary streams, checks table checksums and continuity counters, reassembles the
PES packets and reports timestamps with their random-access flags.

Defined cases: null and empty texts give 64 zero bytes; repeated rows and equal texts give equal values;
an empty table gives an empty result; other columns are ignored. A text of any length is stored whole.
Foreign and damaged streams don't fail: bytes outside of packets count as sync errors, sections with a wrong
checksum or a missing end as table errors, and so do PES packets without a start code; lost packets as
continuity errors, where a repeated packet must equal the one before it; PES packets shorter than they
say, as after a loss of 16 packets that no counter shows, as length errors. A stream without tables has no units.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, sized, table

# Fixed values of the format.
PACKET, SYNC, PAT_PID, PMT_PID, ES_PID, PROGRAM = 188, 0x47, 0, 0x100, 0x101, 1
STREAM_TYPE_PRIVATE, PRIVATE_STREAM_1, CLOCK = 0x06, 0xBD, 90_000
#: Payload bytes of one PES packet, ticks between two, and PES packets from one random-access point to the next.
UNIT, TICKS, GROUP = 16_384, 3_600, 8


@lru_cache(4096)
def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def section(table_id: int, table_id_extension: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + table_id_extension.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


@lru_cache(64)
def table_packet(pid: int, counter: int) -> bytes:
    if pid == PAT_PID:
        data = section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    else:
        data = section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([STREAM_TYPE_PRIVATE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0")
    head = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + bytes([0x10 | counter])
    return (head + b"\0" + data).ljust(PACKET, b"\xff")


def timestamp(pts: int) -> bytes:
    pts &= (1 << 33) - 1
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 1 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 1 | pts << 1 & 0xFE])


def pes_packet(data: bytes, pts: int) -> bytes:
    return b"\0\0\1" + bytes([PRIVATE_STREAM_1]) + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + timestamp(pts) + data


def clock_reference(base: int) -> bytes:
    """A program clock reference of ``base`` ticks of 90 kHz."""
    return ((base & (1 << 33) - 1) << 15 | 0x3F << 9).to_bytes(6, "big")


def packets(pes: bytes, counter: int, random_access: bool, clock: int) -> np.ndarray:
    """The transport packets of one PES packet, as rows of bytes; the first has the clock."""
    held = min(176, len(pes))
    full, rest = divmod(len(pes) - held, 184)
    n = 1 + full + (rest > 0)
    out = np.empty((n, PACKET), np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
    out[:, 3] = 0x10 | (np.arange(counter, counter + n) & 15)
    raw = np.frombuffer(pes, np.uint8)
    out[1 : 1 + full, 4:] = raw[held : held + 184 * full].reshape(full, 184)
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    out[0, 4], out[0, 5] = 183 - held, 0x50 if random_access else 0x10
    out[0, 6:12] = np.frombuffer(clock_reference(clock), np.uint8)
    out[0, 12 : PACKET - held], out[0, PACKET - held :] = 0xFF, raw[:held]
    if rest:
        spare = 184 - rest
        out[-1, 3] |= 0x20
        out[-1, 4] = spare - 1
        out[-1, 5 : 4 + spare] = 0xFF
        if spare > 1:
            out[-1, 5] = 0
        out[-1, 4 + spare :] = raw[len(raw) - rest :]
    return out


def mux(payload: bytes, unit: int = UNIT, ticks: int = TICKS, group: int = GROUP) -> bytes:
    out, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, max(1, len(payload)), unit)):
        if k % group == 0:
            out += [table_packet(PAT_PID, tables & 15), table_packet(PMT_PID, tables & 15)]
            tables += 1
        rows = packets(pes_packet(payload[at : at + unit], (k + 1) * ticks), counter, k % group == 0, k * ticks)
        counter = counter + len(rows) & 15
        out.append(rows.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """What :func:`demux` found."""

    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    sync_errors: int = 0
    table_errors: int = 0
    continuity_errors: int = 0
    length_errors: int = 0
    clocks: dict[int, list[int]] = field(default_factory=dict)  #: of each clock's PID, in ticks of 27 MHz
    units: list[tuple[int, int, bool]] = field(default_factory=list)  #: (PTS or -1, bytes, random access)
    payload: bytes = b""


class Rows:
    """A stream's packets as rows of bytes, and what their headers say."""

    def __init__(self, media: bytes, got: Stream) -> None:
        rows = np.frombuffer(media, np.uint8)
        got.sync_errors += len(rows) % PACKET != 0
        rows = rows[: len(rows) // PACKET * PACKET].reshape(-1, PACKET)
        good = rows[:, 0] == SYNC
        got.packets, got.sync_errors = len(rows), got.sync_errors + int((~good).sum())
        self.rows = rows = rows[good]
        self.pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
        self.unit_start = rows[:, 1] & 0x40 > 0
        adapted = rows[:, 3] & 0x20 > 0
        self.start = np.minimum(np.where(adapted, rows[:, 4].astype(np.int32) + 5, 4), PACKET)
        self.flags = np.where(adapted & (rows[:, 4] > 0), rows[:, 5], 0)

    def of(self, pid: int) -> tuple[np.ndarray, np.ndarray]:
        """Packets of a PID that carry data, without repeated ones, and whether some are missing before each."""
        mine = np.flatnonzero((self.pid == pid) & (self.rows[:, 3] & 0x10 > 0))
        step = np.diff(self.rows[mine, 3] & 15) & 15
        same = step == 0
        for k in np.flatnonzero(same):
            a, b = self.rows[mine[k], self.start[mine[k]] :], self.rows[mine[k + 1], self.start[mine[k + 1]] :]
            same[k] = np.array_equal(a, b)
        lost = np.concatenate([[False], (step != 1) & ~same])[: len(mine)] & (self.flags[mine] & 0x80 == 0)
        first = np.concatenate([[True], ~same])[: len(mine)]
        return mine[first], lost[first]

    def sections(self, pid: int, table_id: int, got: Stream) -> list[bytes]:
        """The sections of a table, put together from the packets of its PID."""
        out: list[bytes] = []
        held: bytearray | None = None  # of the section that is not whole yet

        def whole(data: bytearray) -> bytearray | None:
            """Takes the whole sections off ``data``; what remains of a section, if any."""
            while data and data[0] != 0xFF:
                size = 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)
                if len(data) < 3 or len(data) < size:
                    return data
                if size < 12 or crc32_mpeg(bytes(data[:size])):
                    got.table_errors += 1
                elif data[0] == table_id:
                    out.append(bytes(data[:size]))
                data = data[size:]
            return None

        for k, gone in zip(*self.of(pid), strict=True):
            data = self.rows[k, self.start[k] :].tobytes()
            if gone:
                got.continuity_errors += 1
                got.table_errors += held is not None
                held = None
            if not self.unit_start[k]:
                held = whole(held + data) if held is not None else None
                continue
            pointer = data[0] if data else 0
            if held is not None:
                got.table_errors += whole(held + data[1 : 1 + pointer]) is not None
            held = whole(bytearray(data[1 + pointer :]))
        got.table_errors += held is not None
        return out


def demux(media: bytes) -> Stream:
    got = Stream()
    p = Rows(media, got)
    for s in p.sections(PAT_PID, 0, got):
        got.programs |= {int.from_bytes(s[i : i + 2], "big"): int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF for i in range(8, len(s) - 4, 4)}
    for table_pid in sorted({pid for program, pid in got.programs.items() if program}):
        for s in p.sections(table_pid, 2, got):
            got.clocks.setdefault(int.from_bytes(s[8:10], "big") & 0x1FFF, [])
            at = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
            while at + 5 <= len(s) - 4:
                got.streams[int.from_bytes(s[at + 1 : at + 3], "big") & 0x1FFF] = s[at]
                at += 5 + (int.from_bytes(s[at + 3 : at + 5], "big") & 0xFFF)
    for pid, clock in got.clocks.items():
        for row in p.rows[(p.pid == pid) & (p.flags & 0x10 > 0)]:
            v = int.from_bytes(row[6:12].tobytes(), "big")
            clock.append((v >> 15) * 300 + (v & 0x1FF))
    parts = []
    for es in sorted(got.streams):
        mine, lost = p.of(es)
        got.continuity_errors += int(lost.sum())
        own, begin = p.rows[mine], p.start[mine]
        data = own[np.arange(PACKET) >= begin[:, None]].tobytes()
        ends = np.cumsum(PACKET - begin)
        at = np.flatnonzero(p.unit_start[mine])
        flagged = p.flags[mine[at]] & 0x40 > 0
        bounds = [*(ends[at] - (PACKET - begin[at])).tolist(), len(data)]
        for a, b, ra in zip(bounds, bounds[1:], flagged.tolist(), strict=False):
            if data[a : a + 3] != b"\0\0\1" or b - a < 9:
                got.table_errors += 1
                continue
            size = int.from_bytes(data[a + 4 : a + 6], "big")
            got.length_errors += size > 0 and b - a < 6 + size
            b = min(b, a + 6 + size) if size else b
            stamp, pts = data[a + 9 : a + 14], -1
            if data[a + 7] & 0x80 and len(stamp) == 5:
                pts = (stamp[0] >> 1 & 7) << 30 | stamp[1] << 22 | stamp[2] >> 1 << 15 | stamp[3] << 7 | stamp[4] >> 1
            body = data[a + 9 + data[a + 8] : b]
            got.units.append((pts, len(body), ra))
            parts.append(body)
    got.payload = b"".join(parts)
    return got


def pad(data: bytes, to: int = 64) -> bytes:
    return data + bytes(to - len(data) if not data else -len(data) % to)


def feature(s: Stream) -> str:
    """Structure and sample statistics of the decoded stream."""
    x = np.frombuffer(s.payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / max(1, len(x))
    return f"pkt={s.packets};pes={len(s.units)};rap={sum(u[2] for u in s.units)};pts={s.units[0][0]}-{s.units[-1][0]};cc={s.continuity_errors};mean={x.mean():.4f};std={x.std():.4f};bits={-(p * np.log2(p)).sum() + 0.0:.4f}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pes_packets long, random_access_points long, continuity_errors long, length_errors long"


def media_rows():
    def each(doc_id, text):
        data = (text or "").encode("utf-8", "surrogatepass")
        media = mux(pad(data))
        s = demux(media)
        raps = sum(u[2] for u in s.units)
        yield doc_id, len(data), len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), len(s.units), raps, s.continuity_errors, s.length_errors

    return each


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id and the stored stream of every row: media binary, units array of (pts, bytes, random_access)."""

    def make():
        def each(doc_id, text):
            media = mux(pad((text or "").encode("utf-8", "surrogatepass")))
            yield doc_id, media, [{"pts": p, "bytes": n, "random_access": r} for p, n, r in demux(media).units]

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, media binary, units array<struct<pts:long,bytes:long,random_access:boolean>>")


def op1_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sized(map_rows(docs.select(F.col("doc_id").cast("long"), "text"), media_rows, SCHEMA), docs.count())
