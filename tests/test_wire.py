import random
import socket
import struct

import pytest
from pyspark.sql import functions as F

from ticktally.operators.report import report
from ticktally.plans.conf import parse_report_conf
from ticktally.sources import udp, wire

BASE = {"hostname": "h1", "server_name": "s", "script_name": "a.php", "request_count": 1, "document_size": 10, "memory_peak": 5, "request_time": 0.25, "ru_utime": 0.5, "ru_stime": 0.125}
TIMED = BASE | {"timer_hit_count": [1, 2], "timer_value": [0.5, 0.25], "timer_tag_count": [1, 2], "timer_tag_name": [0, 0, 2], "timer_tag_value": [1, 3, 1], "dictionary": ["group", "db", "op", "x"], "tag_name": [0], "tag_value": [3], "status": 404, "schema": "https", "timer_ru_utime": [0.5]}


def lz4_literals(data: bytes) -> bytes:
    """A block of literals only."""
    out, n = bytearray(), len(data)
    out.append(min(n, 15) << 4)
    if n >= 15:
        n -= 15
        out += b"\xff" * (n // 255) + bytes([n % 255])
    return bytes(out) + data


def test_round_trip_and_framing():
    raw = wire.encode_message(TIMED)
    m = wire.decode_message(raw)
    assert {k: m[k] for k in TIMED} == TIMED
    assert wire.unframe(raw) == raw and wire.unframe(b"\x10\0\0\0" + raw) == raw
    assert wire.unframe(b"\x11\0\0\0" + lz4_literals(raw)) == raw and wire.unframe(b"\x10\x01\0\0" + lz4_literals(raw)) == raw
    assert wire.unframe(b"\x10\0") == b"\x10\0"
    unpacked = wire.encode_message(BASE) + b"".join(bytes([10 << 3, h]) for h in (1, 2))
    assert wire.decode_message(unpacked + b"\xf8\x07\x05")["timer_hit_count"] == [1, 2]  # unknown field 127 skipped
    assert wire.decode_message(wire.encode_message(BASE | {"requests": [BASE]}))["hostname"] == "h1"


def test_lz4_matches():
    assert wire.lz4_block(bytes([0x12, ord("a"), 1, 0, 0x10, ord("z")])) == b"aaaaaaaz"
    assert wire.lz4_block(bytes([0x3F]) + b"abc" + bytes([3, 0, 2, 0x00])) == (b"abc" * 20)[: 3 + 4 + 15 + 2]
    for bad in (b"\xf0", b"\x10", b"\x12a\x05\x00", b"\x12a\x00\x00"):
        with pytest.raises(wire.DecodeError):
            wire.lz4_block(bad)
    with pytest.raises(wire.DecodeError):
        wire.lz4_block(lz4_literals(b"x" * 70000))


@pytest.mark.parametrize("missing", [n for n, (*_, need) in wire.FIELDS.items() if need])
def test_required(missing):
    with pytest.raises(wire.DecodeError):
        wire.decode_message(wire.encode_message({k: v for k, v in BASE.items() if k != missing}))
    with pytest.raises(wire.DecodeError):
        wire.decode_message(wire.encode_message(BASE | {"requests": [{k: v for k, v in BASE.items() if k != missing}]}))


def test_garbage_never_crashes():
    r = random.Random(1)
    raw = wire.encode_message(TIMED)
    for _ in range(300):
        b = bytearray(raw[: r.randint(0, len(raw))])
        for _ in range(3):
            if b:
                b[r.randrange(len(b))] = r.randrange(256)
        try:
            wire.decode_message(bytes(b))
        except wire.DecodeError:
            pass


REJECTED = {
    "okay": {}, "status_is_too_large": {"status": 2**32 - 1}, "bad_hit_count": {"timer_hit_count": [1]}, "bad_tag_count": {"timer_tag_count": [3]}, "bad_timer_hit_count": {"timer_hit_count": [0, 1]},
    "not_enough_tag_names": {"timer_tag_name": [0, 0]}, "not_enough_tag_values": {"timer_tag_value": [1]}, "bad_float_request_time": {"request_time": float("nan")}, "bad_float_ru_utime": {"ru_utime": float("inf")}, "bad_float_ru_stime": {"ru_stime": 1e-40},
    "bad_float_timer_value": {"timer_value": [0.5, float("-inf")]}, "negative_float_timer_value": {"timer_value": [0.5, -0.0]}, "bad_float_timer_ru_utime": {"timer_ru_utime": [float("nan")]}, "bad_float_timer_ru_stime": {"timer_ru_stime": [1e-39]},
    "bad_dictionary_offset": {"timer_tag_name": [0, 0, 9]}, "bad_request_tags": {"tag_name": [0, 0]},
}


def test_validation_and_ingest(spark):
    rows = [(i, bytearray(wire.encode_message(TIMED | change))) for i, change in enumerate(REJECTED.values())]
    rows += [(98, bytearray(b"\x00")), (99, None), (100, bytearray(wire.encode_message(TIMED | {"request_time": -1.0, "ru_utime": -2.0, "timer_ru_utime": [-1.0]})))]
    w = wire.decode(spark.createDataFrame(rows, "n bigint, datagram binary"), "datagram", ["n"])
    got = {r.n: r.e for r in w.select("n", wire.validation_error(w).alias("e")).collect()}
    assert [got[i] or "okay" for i in range(len(REJECTED))] == list(REJECTED)
    assert got[98] == got[99] == "packet_decode_err" and got[100] is None
    assert {r.result: r.packets for r in wire.rejections(w).collect()}["packet_decode_err"] == 2
    s = wire.ingest(w.withColumn("ts", F.lit("2030-01-01").cast("timestamp")), "n", "ts")
    a, b = s.requests.orderBy("request_id").collect()
    assert a.status == "404" and a.request_time_ns == 250_000_000 and [tuple(t) for t in a.tags] == [("group", "x")]
    assert [(t.hit_count, t.value_ns, t.ru_utime_ns, [tuple(x) for x in t.tags]) for t in a.timers] == [(1, 500_000_000, 500_000_000, [("group", "db")]), (2, 250_000_000, 0, [("group", "x"), ("op", "db")])]
    assert (b.request_time_ns, b.ru_utime_ns, b.timers[0].ru_utime_ns) == (0, 0, 0)
    out = report(s, parse_report_conf("v2/timer/60/@group/no_percentiles/no_filters")).collect()
    assert {r.group: r.hit_count for r in out} == {"db": 2, "x": 4}


def test_udp_reader():
    r = udp.UdpReader({"port": "0", "address": "127.0.0.1", "batch_timeout_ms": "300"})
    to = r.sock.getsockname()
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for i in range(3):
            s.sendto(struct.pack("<I", i), to)
    rows, end = r.read(r.initialOffset())
    assert [x[2] for x in rows] == [struct.pack("<I", i) for i in range(3)] and end == {"packets": 3}
    r.sock.close()


def test_library_reads_as_the_decoder_does():
    """Whole, cut off and damaged messages: the same message or an error from both."""

    def outcome(read, b):
        try:
            return repr(sorted(read(b).items()))  # NaN equals itself here
        except wire.DecodeError as e:
            return str(e)

    r = random.Random(3)
    whole = [wire.encode_message(m) for m in (BASE, TIMED, TIMED | {"requests": [BASE]}, BASE | {"requests": [{"hostname": "x"}]}, TIMED | {"request_time": float("nan"), "hostname": b"\xff"})]
    unpacked = wire.encode_message(BASE) + b"".join(bytes([10 << 3, h]) for h in (1, 2)) + b"\xf8\x07\x05"
    mixed = wire.encode_message(BASE) + bytes([1 << 3, 7]) + bytes([6 << 3]) + b"\xff\xff\xff\xff\x1f"
    for b in (*whole, unpacked, mixed, b"", b"\x00"):
        assert outcome(wire.parse_message, b) == outcome(wire.decode_message, b)
        for _ in range(150):
            x = bytearray(b[: r.randint(0, len(b))] if r.random() < 0.5 else b)
            for _ in range(r.randint(0, 2)):
                if x:
                    x[r.randrange(len(x))] = r.randrange(256)
            assert outcome(wire.parse_message, bytes(x)) == outcome(wire.decode_message, bytes(x)), bytes(x)
