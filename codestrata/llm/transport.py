"""Operator 7: media columns of MPEG transport streams.

A binary column of transport streams (ISO/IEC 13818-1) becomes one row for each
elementary packet: the program association and map tables name programs and streams,
continuity counters tell lost packets, payloads between two starts are joined, and
headers give presentation and decoding times and the random-access points. Fields of
all transport packets of a stream are decoded as columns; only tables and elementary
packets are looked at one by one.

No table here has media, so ``muxed`` writes the texts of a table as streams: two
programs' worth of tables, texts cut into access units on two elementary streams,
clock references, stuffing, and on some streams a lost or a repeated packet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _kernels as K
from ._frames import batched, id_text, table

PACKET = 188
SYNC = 0x47
UNIT_BYTES = 1500
"""Text bytes of an access unit of ``muxed``."""
CHUNK = 1 << 20
SCHEMA = "media_id bigint, program int, pid int, stream_type int, unit int, stream_id int, pts bigint, dts bigint, random_access boolean, packets int, lost int, repeated int, complete boolean, size int, payload binary"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary()]


def crc32(data: bytes) -> int:
    """The CRC of table sections: polynomial 0x04C11DB7, most significant bit first, no final inversion."""
    crc = 0xFFFFFFFF
    for b in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ b]
    return crc


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c)
    return out


_CRC = _crc_table()

# -- writing streams


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return head + crc32(head).to_bytes(4, "big")


def _stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 29 & 0x0E) | 1, t >> 22 & 255, (t >> 14 & 0xFE) | 1, t >> 7 & 255, (t << 1 & 0xFE) | 1])


def _packets(pid: int, data: bytes, counter: int, start: bool, random_access: bool = False, clock: int | None = None) -> tuple[np.ndarray, int]:
    """Transport packets of one payload, as rows of bytes, and the next counter."""
    lead = b""
    if random_access or clock is not None:
        lead = bytes([(0x40 if random_access else 0) | (0x10 if clock is not None else 0)])
        if clock is not None:
            lead += ((clock << 15) | 0x7E00).to_bytes(6, "big")
    room = 184 - (len(lead) + 1 if lead else 0)
    n = 1 + max(0, -(-(len(data) - room) // 184))
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0] = SYNC
    out[:, 1], out[:, 2] = pid >> 8, pid & 255
    out[0, 1] |= 0x40 if start else 0
    out[:, 3] = 0x10 | (counter + np.arange(n)) % 16
    raw = np.frombuffer(data, np.uint8)
    first = min(len(raw), room)
    pad = room - first
    if lead or pad:
        out[0, 3] |= 0x20
        size = 183 - first
        out[0, 4] = size
        if size:
            out[0, 5] = lead[0] if lead else 0
            out[0, 6 : 5 + len(lead)] = np.frombuffer(lead[1:], np.uint8) if lead else 0
    out[0, PACKET - first :] = raw[:first]
    rest = raw[first:]
    whole = len(rest) // 184
    if whole:
        out[1 : 1 + whole, 4:] = rest[: whole * 184].reshape(-1, 184)
    tail = rest[whole * 184 :]
    if len(tail):
        size = 183 - len(tail)
        out[-1, 3] |= 0x20
        out[-1, 4] = size
        if size:
            out[-1, 5] = 0
        out[-1, PACKET - len(tail) :] = tail
    return out, (counter + n) % 16


_PAT = _section(0x00, 1, bytes([0, 1, 0xE0 | 0x10, 0x00]))
_PMT = _section(0x02, 1, bytes([0xE1, 0x00, 0xF0, 0, 0x1B, 0xE1, 0x00, 0xF0, 0, 0x0F, 0xE1, 0x01, 0xF0, 0]))


def mux(key: int, data: bytes) -> bytes:
    """One stream of ``data``: units alternate between pids 0x100 and 0x101 of program 1."""
    out: list[np.ndarray] = []
    counters = {0: 0, 0x1000: 0, 0x100: 0, 0x101: 0}
    for u, a in enumerate(range(0, len(data), UNIT_BYTES)):
        if u % 20 == 0:
            for pid, section in ((0, _PAT), (0x1000, _PMT)):
                rows, counters[pid] = _packets(pid, b"\0" + section + b"\xff" * (183 - len(section)), counters[pid], True)
                out.append(rows)
        pid = 0x100 + u % 2
        pts = 126_000 + 3_600 * u
        stamps = _stamp(3, pts) + _stamp(1, pts - 3_600) if pid == 0x100 else _stamp(2, pts)
        head = bytes([0x80, 0xC0 if pid == 0x100 else 0x80, len(stamps)]) + stamps
        part = data[a : a + UNIT_BYTES]
        size = len(head) + len(part)
        rows, counters[pid] = _packets(pid, bytes([0, 0, 1, 0xE0 if pid == 0x100 else 0xC0, size >> 8, size & 255]) + head + part, counters[pid], True, u % 8 == 0, (pts - 7_200) if pid == 0x100 else None)
        out.append(rows)
    if not out:
        return b""
    every = np.concatenate(out)
    if key % 17 == 3 and len(every) > 4:
        every = np.delete(every, 3 + key % (len(every) - 4), axis=0)
    elif key % 19 == 5 and len(every) > 4:
        at = 2 + key % (len(every) - 2)
        every = np.insert(every, at, every[at], axis=0)
    return every.tobytes()


def muxed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(media_id, media): the texts of a table as transport streams; a null text is a null stream."""

    def one(batch: pa.RecordBatch):
        for a, b in K.chunks(batch.column(1), CHUNK):
            data, offs = K.utf8_parts(batch.column(1).slice(a, b - a))
            ids = batch.column(0).slice(a, b - a).fill_null(0).to_pylist()
            null = batch.column(1).slice(a, b - a).is_null().to_pylist()
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([None if x else mux(i, raw[p:q]) for i, x, p, q in zip(ids, null, offs[:-1].tolist(), offs[1:].tolist(), strict=True)], pa.binary())], ["media_id", "media"])

    return id_text(docs, id_col, text_col).mapInArrow(batched(one), "media_id bigint, media binary")


# -- reading streams


def synced(data: np.ndarray) -> np.ndarray:
    """The transport packets of a stream as rows; bytes out of step are skipped.

    A packet starts at a sync byte that follows a packet, or is followed by another one packet on, or by the end.
    """
    whole = len(data) // PACKET
    rows = data[: whole * PACKET].reshape(-1, PACKET)
    if (rows[:, 0] == SYNC).all():
        return rows
    n = len(data)
    good = np.flatnonzero(data == SYNC)
    good = good[good + PACKET <= n].tolist()
    starts: list[int] = []
    k, in_step = 0, -1
    while k < len(good):
        at = good[k]
        if at == in_step or at + PACKET == n or data[at + PACKET] == SYNC:
            starts.append(at)
            in_step = at + PACKET
            while k < len(good) and good[k] < in_step:
                k += 1
        else:
            k += 1
    if not starts:
        return rows[:0]
    return data[np.array(starts)[:, None] + np.arange(PACKET)[None, :]]


def _tables(rows: np.ndarray, begin: np.ndarray, pids: np.ndarray, starts: np.ndarray, has: np.ndarray) -> dict[int, tuple[int, int]]:
    """pid -> (program, stream type), from the tables with a right CRC.

    Of several tables of one program a later one wins; a pid that several programs share
    counts for that of the least number.
    """

    def sections(pid: int):
        at = np.flatnonzero((pids == pid) & has)
        held = b""
        open_ = False
        for i in at.tolist():
            payload = rows[i, begin[i] :].tobytes()
            if starts[i]:
                if not payload:
                    continue
                held, open_ = payload[1 + payload[0] :], True
            elif open_:
                held += payload
            while open_ and len(held) >= 3 and held[0] != 0xFF:
                size = 3 + ((held[1] & 0x0F) << 8 | held[2])
                if len(held) < size:
                    break
                yield held[:size]
                held = held[size:]
            if open_ and held[:1] == b"\xff":
                open_ = False

    maps: dict[int, int] = {}
    seen: set[bytes] = set()
    for s in sections(0):
        if s in seen or s[0] != 0 or len(s) < 12 or crc32(s):
            continue
        seen.add(s)
        for k in range(8, len(s) - 4, 4):
            number, pid = s[k] << 8 | s[k + 1], (s[k + 2] & 0x1F) << 8 | s[k + 3]
            if number:
                maps[pid] = number
    found: dict[tuple[int, int], int] = {}
    for pid in maps:
        seen = set()
        for s in sections(pid):
            if s in seen or s[0] != 2 or len(s) < 16 or crc32(s):
                continue
            seen.add(s)
            number = s[3] << 8 | s[4]
            k = 12 + ((s[10] & 0x0F) << 8 | s[11])
            while k + 5 <= len(s) - 4:
                found[number, (s[k + 1] & 0x1F) << 8 | s[k + 2]] = s[k]
                k += 5 + ((s[k + 3] & 0x0F) << 8 | s[k + 4])
    return {pid: (number, kind) for (number, pid), kind in sorted(found.items(), reverse=True)}


def _time(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def units(data: np.ndarray) -> list[tuple]:
    """The elementary packets of one stream: the fields of ``SCHEMA`` after the id, by pid and place."""
    rows = synced(data)
    if not len(rows):
        return []
    rows = rows[(rows[:, 1] & 0x80) == 0]
    pids = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    starts = (rows[:, 1] & 0x40) > 0
    control = rows[:, 3] >> 4 & 3
    hidden = rows[:, 3] >> 6 > 0
    counters = rows[:, 3] & 15
    adapted = (control & 2) > 0
    length = np.where(adapted, rows[:, 4].astype(np.int64), -1)
    begin = np.where(adapted, 5 + length, 4)
    has = ((control & 1) > 0) & (begin < PACKET)
    flags = np.where(adapted & (length > 0), rows[:, 5], 0)
    out: list[tuple] = []
    for pid, (program, kind) in sorted(_tables(rows, begin, pids, starts, has).items()):
        mine = np.flatnonzero((pids == pid) & ((control & 1) > 0))
        if not len(mine):
            continue
        step = np.zeros(len(mine), np.int64)
        step[1:] = (counters[mine[1:]].astype(np.int64) - counters[mine[:-1]]) % 16
        repeat = np.zeros(len(mine), bool)
        repeat[1:] = (step[1:] == 0) & (rows[mine[1:], 4:] == rows[mine[:-1], 4:]).all(axis=1)
        lost = np.where(repeat | ((flags[mine] & 0x80) > 0), 0, (step - 1) % 16)
        lost[0] = 0
        first = np.flatnonzero(starts[mine] & ~repeat)
        ends = np.append(first[1:], len(mine))[: len(first)]
        for u, (a, b) in enumerate(zip(first.tolist(), ends.tolist(), strict=True)):
            if hidden[mine[a]]:
                continue
            keep = mine[a:b][~repeat[a:b] & has[mine[a:b]] & ~hidden[mine[a:b]]]
            at, size = begin[keep], PACKET - begin[keep]
            flat = rows[np.repeat(keep, size), K.ragged(at, size)].tobytes()
            if len(flat) < 6 or flat[:3] != b"\0\0\1":
                continue
            sid, told = flat[3], flat[4] << 8 | flat[5]
            pts = dts = None
            body = 6
            if sid not in (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF) and len(flat) >= 9:
                body = 9 + flat[8]
                if flat[7] & 0x80 and len(flat) >= 14:
                    pts = dts = _time(flat[9:14])
                if flat[7] & 0xC0 == 0xC0 and len(flat) >= 19:
                    dts = _time(flat[14:19])
            payload = flat[body : 6 + told] if told else flat[body:]
            gaps = int(lost[a + 1 : b].sum())
            complete = gaps == 0 and not hidden[mine[a:b]].any() and (len(flat) >= 6 + told) and (b < len(mine) and lost[b] == 0 or b == len(mine))
            out.append((program, pid, kind, u, sid, pts, dts, bool(flags[mine[a]] & 0x40), len(keep), gaps + (int(lost[a]) if a == first[0] or lost[a] else 0), int(repeat[a:b].sum()), bool(complete), len(payload), payload))
    return out


def parse(media: DataFrame, id_col: str = "media_id", media_col: str = "media") -> DataFrame:
    """One row for each elementary packet of a column of transport streams.

    ``unit`` counts the packets of a pid from 0; ``pts`` and ``dts`` are in 90 kHz ticks,
    null where the header has none (a lone pts is the dts too); ``random_access`` is the
    indicator of its first transport packet; ``lost`` are transport packets missing by the
    counter before or within it, ``repeated`` those sent twice and used once; ``complete``
    is false where packets are missing within it or right after it, or fewer bytes came
    than the header told. ``payload`` are the bytes that did come.

    Null, empty and unsynchronised streams, and those without a readable program table,
    give no rows; bytes out of step and a cut last packet are skipped; payload before a
    pid's first start is dropped, and so are packets with the error flag. Scrambled packets
    can't be read: an elementary packet that begins with one gives no row, but counts, and
    one with any is not complete. Repeated rows and ids are parsed each; a null id stays null. Other columns are not read. No shuffle.
    """

    def one(batch: pa.RecordBatch):
        for a, b in K.chunks(batch.column(1), CHUNK):
            data, offs = K.utf8_parts(batch.column(1).slice(a, b - a))
            out = [(i, *u) for i, p, q in zip(batch.column(0).slice(a, b - a).to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True) for u in units(data[p:q])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], FIELDS)

    picked = media.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{media_col}`").cast("binary").alias("media"))
    return picked.mapInArrow(batched(one), SCHEMA)


def op7_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(muxed(table(spark, sf_dir, "documents")))
