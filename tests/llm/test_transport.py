"""Streams put together by hand from the standard, with tables as other multiplexers write them."""

import numpy as np

from codestrata.llm import transport

PAT = bytes.fromhex("00 00b00d0001c100000001f0002ab104b2")
PMT = bytes.fromhex("00 02b0120001c10000e100f0001be100f00015bd4d56")


def packet(pid, payload, counter=0, start=False, control=1, adaptation=None, error=False, scrambled=0):
    """188 bytes; what the payload leaves is filled by an adaptation field."""
    lead = b""
    room = 184 - len(payload)
    if adaptation is not None or room:
        flags = adaptation or b""
        size = room - 1
        lead = bytes([size]) + (flags or b"\0" if size else b"")
        lead += b"\xff" * (size + 1 - len(lead))
        control |= 2
    head = bytes([0x47, (0x80 if error else 0) | (0x40 if start else 0) | pid >> 8, pid & 255, scrambled << 6 | control << 4 | counter % 16])
    out = head + lead + payload
    assert len(out) == 188, len(out)
    return out


def tables(*sections):
    return b"".join(packet(pid, s + b"\xff" * (184 - len(s)), start=True) for pid, s in sections)


HEAD = bytes.fromhex("000001e00000 808005 210007d861")


def units(raw):
    return [dict(zip(transport.FIELDS[1:], u, strict=True)) for u in transport.units(np.frombuffer(raw, np.uint8))]


BASE = tables((0, PAT), (0x1000, PMT))


def test_tables_of_another_multiplexer_have_a_right_crc():
    assert transport.crc32(PAT[1:]) == 0 and transport.crc32(PMT[1:]) == 0


def test_one_packet_with_a_time_and_a_random_access_point():
    (u,) = units(BASE + packet(0x100, HEAD + b"frame", start=True, adaptation=b"\x40"))
    assert (u["program"], u["pid"], u["stream_type"], u["stream_id"]) == (1, 0x100, 0x1B, 0xE0)
    assert (u["pts"], u["dts"], u["random_access"], u["complete"], u["payload"]) == (126_000, 126_000, True, True, b"frame")


def test_both_times_and_a_told_length():
    stamps = bytes.fromhex("3100 07d861 1100 07bc41")
    body = bytes([0x80, 0xC0, 10]) + stamps + b"abc"
    (u,) = units(BASE + packet(0x100, b"\0\0\1\xe0" + len(body).to_bytes(2, "big") + body + b"stuffing", start=True))
    assert u["pts"] == 126_000 and u["dts"] == (0x07 & 0xFE) << 14 | 0xBC << 7 | 0x41 >> 1 and u["payload"] == b"abc"
    # fewer bytes than the header told
    (u,) = units(BASE + packet(0x100, b"\0\0\1\xe0\x01\x00" + body, start=True))
    assert not u["complete"]


def pieces(counters, marks=()):
    first = packet(0x100, HEAD + b"a" * 170, counters[0], start=True)
    return BASE + first + b"".join(packet(0x100, bytes([98 + k]) * 184, c, **(marks[k] if k < len(marks) else {})) for k, c in enumerate(counters[1:]))


def test_continuity():
    (u,) = units(pieces([14, 15, 0, 1]))
    assert u["complete"] and u["lost"] == 0 and u["payload"] == b"a" * 170 + b"b" * 184 + b"c" * 184 + b"d" * 184
    (u,) = units(pieces([14, 15, 2, 3]))
    assert not u["complete"] and u["lost"] == 2 and u["packets"] == 4
    same = BASE + packet(0x100, HEAD + b"a" * 170, 4, start=True) + 2 * packet(0x100, b"b" * 184, 5) + packet(0x100, b"c" * 184, 6)
    (u,) = units(same)
    assert u["complete"] and u["repeated"] == 1 and u["payload"] == b"a" * 170 + b"b" * 184 + b"c" * 184
    (u,) = units(pieces([1, 2, 3], [{"error": True}]))
    assert not u["complete"] and u["lost"] == 1 and b"b" not in u["payload"]


def test_scrambled_packets():
    (u,) = units(pieces([1, 2, 3], [{"scrambled": 2}]))
    assert not u["complete"] and u["lost"] == 0 and u["payload"] == b"a" * 170 + b"c" * 184
    raw = BASE + packet(0x100, HEAD + b"x" * 170, 1, start=True, scrambled=3) + packet(0x100, HEAD + b"y" * 170, 2, start=True)
    (u,) = units(raw)
    assert u["unit"] == 1 and u["payload"] == b"y" * 170


def section(table, number, body):
    return b"\0" + transport._section(table, number, body)


def test_programs_that_share_a_pid_and_new_tables():
    pat = section(0, 1, bytes.fromhex("0002 f001 0001 f000"))
    one = section(2, 1, bytes.fromhex("e100 f000 1b e100 f000"))
    two = section(2, 2, bytes.fromhex("e100 f000 0f e100 f000 0f e101 f000"))
    for order in ((one, two), (two, one)):
        got = units(tables((0, pat), *((0x1000 if t is one else 0x1001, t) for t in order)) + packet(0x100, HEAD + b"p", start=True) + packet(0x101, HEAD + b"q", start=True))
        assert [(u["program"], u["stream_type"], u["pid"]) for u in got] == [(1, 0x1B, 0x100), (2, 0x0F, 0x101)]
    newer = section(2, 1, bytes.fromhex("e100 f000 24 e100 f000"))
    (u,) = units(tables((0, pat), (0x1000, one), (0x1000, newer)) + packet(0x100, HEAD + b"p", start=True))
    assert u["stream_type"] == 0x24
    broken = one[:-1] + bytes([one[-1] ^ 1])
    assert units(tables((0, pat), (0x1000, broken)) + packet(0x100, HEAD + b"p", start=True)) == []


def test_a_table_over_two_packets_and_one_without_a_start():
    long = section(2, 1, b"\xe1\x00\xf0\x00" + b"".join(bytes([0x1B, 0xE1, k, 0xF0, 0x00]) for k in range(60)))
    raw = tables((0, PAT)) + packet(0x1000, long[:184], 0, start=True) + packet(0x1000, long[184:] + b"\xff" * (368 - len(long)), 1)
    got = units(raw + packet(0x13B, HEAD + b"p", start=True) + packet(0x13A, b"z" * 184))
    assert [u["pid"] for u in got] == [0x13B]
