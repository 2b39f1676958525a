"""Datagrams: framing, LZ4 blocks, protobuf messages; decoded rows in the wire schema.

Decoding is one Arrow pass per partition (``decode``); everything after it, from validation to
regrouping timers, is column expressions (``ingest``).  A datagram that can't be decoded keeps
its row with ``decode_error`` set, so that losses can be counted.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durations import to_ns
from ..operators.source import TAGS, TIMERS, Source

LIMIT = 65536  # bytes of a datagram, packed or not

#: Field numbers of the message: name -> (number, kind, repeated, required).  Fixed values.
FIELDS = {
    "hostname": (1, "bytes", False, True), "server_name": (2, "bytes", False, True), "script_name": (3, "bytes", False, True),
    "request_count": (4, "uint", False, True), "document_size": (5, "uint", False, True), "memory_peak": (6, "uint", False, True),
    "request_time": (7, "float", False, True), "ru_utime": (8, "float", False, True), "ru_stime": (9, "float", False, True),
    "timer_hit_count": (10, "uint", True, False), "timer_value": (11, "float", True, False), "timer_tag_count": (12, "uint", True, False),
    "timer_tag_name": (13, "uint", True, False), "timer_tag_value": (14, "uint", True, False), "dictionary": (15, "bytes", True, False),
    "status": (16, "uint", False, False), "memory_footprint": (17, "uint", False, False), "requests": (18, "message", True, False),
    "schema": (19, "bytes", False, False), "tag_name": (20, "uint", True, False), "tag_value": (21, "uint", True, False),
    "timer_ru_utime": (22, "float", True, False), "timer_ru_stime": (23, "float", True, False),
}
_BY_NUMBER = {n: (name, kind, many) for name, (n, kind, many, _) in FIELDS.items()}
_REQUIRED = frozenset(name for name, (*_, need) in FIELDS.items() if need)
_SPARK = {"bytes": "string", "uint": "bigint", "float": "float"}
WIRE = ", ".join(f"`{n}` {f'array<{_SPARK[k]}>' if many else _SPARK[k]}" for n, (_, k, many, _) in FIELDS.items() if k != "message")
_ARROW = {"bytes": pa.string(), "uint": pa.int64(), "float": pa.float32()}


class DecodeError(ValueError):
    pass


def unframe(datagram: bytes) -> bytes:
    """The message's bytes.  A first byte with high nibble 1 and four bytes at least is a header, whose
    lowest flag bit (in either of the first two bytes) says that an LZ4 block follows."""
    if len(datagram) >= 4 and datagram[0] >> 4 == 1:
        packed = (datagram[0] | datagram[1]) & 1
        body = datagram[4:]
        return lz4_block(body) if packed else body
    return datagram


def lz4_block(data: bytes, limit: int = LIMIT) -> bytes:
    """Decompress one LZ4 block of at most ``limit`` bytes."""
    out, i, n = bytearray(), 0, len(data)

    def length(nibble: int, i: int) -> tuple[int, int]:
        if nibble == 15:
            while True:
                if i >= n:
                    raise DecodeError("lz4: cut off")
                nibble += data[i]
                i += 1
                if data[i - 1] != 255:
                    break
        return nibble, i

    while i < n:
        token = data[i]
        lit, i = length(token >> 4, i + 1)
        if i + lit > n:
            raise DecodeError("lz4: cut off")
        out += data[i : i + lit]
        i += lit
        if i == n:
            break
        if i + 2 > n:
            raise DecodeError("lz4: cut off")
        back = data[i] | data[i + 1] << 8
        size, i = length(token & 15, i + 2)
        size += 4
        if not 0 < back <= len(out):
            raise DecodeError("lz4: bad offset")
        if len(out) + size > limit:
            raise DecodeError("lz4: too long")
        while size:  # a match may overlap itself
            piece = out[-back : len(out) - back + size] if back > size else out[-back:]
            out += piece[:size]
            size -= len(piece[:size])
    if len(out) > limit:
        raise DecodeError("lz4: too long")
    return bytes(out)


def _varint(b: bytes, i: int, end: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        if i >= end or shift > 63:
            raise DecodeError("varint")
        v |= (b[i] & 0x7F) << shift
        i += 1
        if b[i - 1] < 128:
            return v, i
        shift += 7


def decode_message(b: bytes, start: int = 0, end: int | None = None, depth: int = 0) -> dict:
    """A message as a dict; repeated numbers may be packed or not, unknown fields are skipped, all required
    fields must be there, also in nested messages (which are checked but not kept)."""
    end = len(b) if end is None else end
    if depth > 100:
        raise DecodeError("nested too deep")
    out: dict = {n: [] for n, (_, _, many, _) in FIELDS.items() if many}
    i = start
    while i < end:
        tag, i = _varint(b, i, end)
        number, wire = tag >> 3, tag & 7
        if number == 0:
            raise DecodeError("field 0")
        if wire == 0:
            v, i = _varint(b, i, end)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            if i + size > end:
                raise DecodeError("cut off")
            v = struct.unpack_from("<f", b, i)[0] if wire == 5 else None
            i += size
        elif wire == 2:
            size, i = _varint(b, i, end)
            if i + size > end:
                raise DecodeError("cut off")
            v, i = (i, i + size), i + size
        else:
            raise DecodeError(f"wire type {wire}")
        if number not in _BY_NUMBER:
            continue
        name, kind, many = _BY_NUMBER[number]
        if kind == "bytes" and wire == 2:
            value: object = b[v[0] : v[1]].decode("utf-8", "replace")
        elif kind == "uint" and wire == 0:
            value = v & 0xFFFFFFFF
        elif kind == "float" and wire == 5:
            value = v
        elif kind == "message" and wire == 2:
            decode_message(b, *v, depth + 1)
            continue
        elif many and wire == 2 and kind == "uint":
            j = v[0]
            while j < v[1]:
                x, j = _varint(b, j, v[1])
                out[name].append(x & 0xFFFFFFFF)
            continue
        elif many and wire == 2 and kind == "float":
            if (v[1] - v[0]) % 4:
                raise DecodeError("packed floats")
            out[name] += struct.unpack_from(f"<{(v[1] - v[0]) // 4}f", b, v[0])
            continue
        else:
            raise DecodeError(f"{name}: wire type {wire}")
        if many:
            out[name].append(value)
        else:
            out[name] = value
    missing = _REQUIRED - out.keys()
    if missing:
        raise DecodeError(f"missing {', '.join(sorted(missing))}")
    return out


@cache
def _message_class():
    """The message's class of the protobuf library, made from ``FIELDS``; None without the library."""
    try:
        from google.protobuf import descriptor_pb2, descriptor_pool, message_factory, unknown_fields
    except ImportError:
        return None
    kinds = {"bytes": 12, "uint": 13, "float": 2, "message": 11}
    file = descriptor_pb2.FileDescriptorProto(name="ticktally/request.proto", package="ticktally", syntax="proto2")
    message = file.message_type.add(name="Request")
    for name, (number, kind, many, need) in FIELDS.items():
        field = message.field.add(name=name, number=number, label=3 if many else 2 if need else 1, type=kinds[kind])
        if kind == "message":
            field.type_name = ".ticktally.Request"
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName("ticktally.Request")), unknown_fields.UnknownFieldSet


def parse_message(b: bytes) -> dict:
    """``decode_message`` by the protobuf library where it can; what it refuses, or what it keeps aside under a
    known number, is read again by ``decode_message``, which alone decides on errors."""
    made = _message_class()
    if made is None:
        return decode_message(b)
    m = made[0]()
    try:
        m.ParseFromString(b)
        if not m.IsInitialized() or any(f.field_number in _BY_NUMBER for f in made[1](m)):
            return decode_message(b)
    except Exception:  # noqa: BLE001 - any refusal is decided below
        return decode_message(b)
    out: dict = {}
    for name, (_, kind, many, _) in FIELDS.items():
        if kind == "message":
            out[name] = []
        elif many:
            v = list(getattr(m, name))
            out[name] = [x.decode("utf-8", "replace") for x in v] if kind == "bytes" else v
        elif m.HasField(name):
            v = getattr(m, name)
            out[name] = v.decode("utf-8", "replace") if kind == "bytes" else v
    return out


def encode_message(m: dict) -> bytes:
    """The bytes of a message, repeated numbers packed (for tests and generators)."""
    out = bytearray()

    def varint(v: int) -> bytes:
        b = bytearray()
        while v > 127:
            b.append(v & 127 | 128)
            v >>= 7
        b.append(v)
        return bytes(b)

    for name, (number, kind, many, _) in FIELDS.items():
        v = m.get(name)
        if v is None or (many and not v):
            continue
        if kind in ("bytes", "message"):
            for x in v if many else [v]:
                raw = x.encode() if isinstance(x, str) else encode_message(x) if isinstance(x, dict) else x
                out += varint(number << 3 | 2) + varint(len(raw)) + raw
        elif many:
            raw = struct.pack(f"<{len(v)}f", *v) if kind == "float" else b"".join(map(varint, v))
            out += varint(number << 3 | 2) + varint(len(raw)) + raw
        elif kind == "float":
            out += varint(number << 3 | 5) + struct.pack("<f", v)
        else:
            out += varint(number << 3) + varint(v)
    return bytes(out)


def decode(df: DataFrame, datagram: str, keep: list[str]) -> DataFrame:
    """Wire rows of datagrams: columns ``keep``, the message's fields, ``decode_error``."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    fields = [(n, pa.list_(_ARROW[k]) if many else _ARROW[k]) for n, (_, k, many, _) in FIELDS.items() if k != "message"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, errors = [], []
            for x in b.column(len(keep)):
                try:
                    raw = x.as_py()
                    if raw is None:
                        raise DecodeError("null")
                    rows.append(parse_message(unframe(bytes(raw))))
                    errors.append(None)
                except DecodeError as e:
                    rows.append({})
                    errors.append(str(e))
            cols = [pa.array([r.get(n) for r in rows], t) for n, t in fields]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *cols, pa.array(errors, pa.string())], names=[*keep, *(n for n, _ in fields), "decode_error"])

    return df.select(*keep, datagram).mapInArrow(run, f"{kinds}{', ' if keep else ''}{WIRE}, decode_error string")


# --- validation -------------------------------------------------------------------------------

_LEAST_NORMAL = 1.1754943508222875e-38  # the least normal 32-bit float


def _abnormal(x: Column) -> Column:
    """NaN, infinite or subnormal."""
    d = x.cast("double")
    return F.isnan(d) | (F.abs(d) == float("inf")) | ((d != 0) & (F.abs(d) < _LEAST_NORMAL))


def _negative(x: Column) -> Column:
    """Sign bit set, so that -0.0 counts."""
    return (x < 0) | (x.cast("string") == "-0.0")


def validation_error(df: DataFrame) -> Column:
    """Why a decoded request is refused, or null.  The first check that fails names it; the names are fixed values."""
    n = lambda c: F.size(F.coalesce(F.col(c), F.array()))
    total = F.aggregate("timer_tag_count", F.lit(0).cast("bigint"), lambda a, c: a + c)
    offset = lambda c: F.exists(c, lambda i: (i < 0) | (i >= n("dictionary")))
    return (
        F.when(F.col("decode_error").isNotNull(), "packet_decode_err")
        .when(F.coalesce("status", F.lit(0)) >= 2**32 - 1, "status_is_too_large")
        .when(n("timer_value") != n("timer_hit_count"), "bad_hit_count")
        .when(n("timer_value") != n("timer_tag_count"), "bad_tag_count")
        .when(F.exists("timer_hit_count", lambda h: h == 0), "bad_timer_hit_count")
        .when(total != n("timer_tag_name"), "not_enough_tag_names")
        .when(total != n("timer_tag_value"), "not_enough_tag_values")
        .when(_abnormal(F.col("request_time")), "bad_float_request_time")
        .when(_abnormal(F.col("ru_utime")), "bad_float_ru_utime")
        .when(_abnormal(F.col("ru_stime")), "bad_float_ru_stime")
        .when(F.exists("timer_value", _abnormal), "bad_float_timer_value")
        .when(F.exists("timer_value", _negative), "negative_float_timer_value")
        .when(F.exists("timer_ru_utime", _abnormal), "bad_float_timer_ru_utime")
        .when(F.exists("timer_ru_stime", _abnormal), "bad_float_timer_ru_stime")
        .when(n("tag_name") != n("tag_value"), "bad_request_tags")
        .when(offset("timer_tag_name") | offset("timer_tag_value") | offset("tag_name") | offset("tag_value"), "bad_dictionary_offset")
    )


def ingest(wire: DataFrame, request_id: str, ts: str) -> Source:
    """Accepted requests in the report schema: negatives clamped to 0, offsets resolved, flat timer arrays regrouped."""
    w = wire.withColumn("__e", validation_error(wire)).where(F.col("__e").isNull())
    ns = lambda x: to_ns(F.greatest(x, F.lit(0.0).cast("float")))
    word = lambda i: F.get("dictionary", i.cast("int"))
    ends = F.aggregate("timer_tag_count", F.array(F.lit(0).cast("bigint")), lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + c)))
    tag = lambda names, values: F.zip_with(names, values, lambda a, b: F.struct(word(a).alias("name"), word(b).alias("value")))
    w = w.withColumn("__at", ends)
    at = F.sequence(F.lit(0), F.greatest(F.size("timer_value") - 1, F.lit(0)))

    def timer(i: Column) -> Column:
        # total even on rows that are refused: the optimizer may evaluate this before the check
        start, count = F.coalesce(F.get("__at", i) + 1, F.lit(1)).cast("int"), F.coalesce(F.get("timer_tag_count", i), F.lit(0)).cast("int")
        part = lambda c: F.slice(c, start, count)
        rest = lambda c: F.coalesce(ns(F.get(c, i)), F.lit(0).cast("bigint"))
        return F.struct(F.get("timer_hit_count", i).alias("hit_count"), ns(F.get("timer_value", i)).alias("value_ns"), rest("timer_ru_utime").alias("ru_utime_ns"), rest("timer_ru_stime").alias("ru_stime_ns"), tag(part("timer_tag_name"), part("timer_tag_value")).alias("tags"))

    timers = F.when(F.size("timer_value") > 0, F.transform(at, timer)).otherwise(F.array().cast(TIMERS)).cast(TIMERS)
    return Source(
        w.select(
            F.col(request_id).alias("request_id"), F.col(ts).alias("ts"), F.col("hostname").alias("host"), F.col("server_name").alias("server"), F.col("script_name").alias("script"), F.coalesce("schema", F.lit("")).alias("schema"),
            F.coalesce("status", F.lit(0)).cast("string").alias("status"), F.col("document_size").alias("traffic"), F.coalesce("memory_footprint", F.lit(0)).cast("bigint").alias("mem_used"),
            ns(F.col("request_time")).alias("request_time_ns"), ns(F.col("ru_utime")).alias("ru_utime_ns"), ns(F.col("ru_stime")).alias("ru_stime_ns"), tag(F.col("tag_name"), F.col("tag_value")).cast(TAGS).alias("tags"), timers.alias("timers"),
        )
    )


def rejections(wire: DataFrame) -> DataFrame:
    """(result, packets): how many datagrams had each outcome."""
    return wire.select(F.coalesce(validation_error(wire), F.lit("okay")).alias("result")).groupBy("result").agg(F.count(F.lit(1)).alias("packets"))


# --- making datagrams ----------------------------------------------------------------------------


def frame(message: bytes, form: int) -> bytes:
    """A datagram: 0 the plain message, 1 with a header, 2 with a header and an LZ4 block of literals."""
    if form == 0:
        return message
    if form == 1:
        return b"\x10\0\0\0" + message
    rest = len(message) - 15
    length = bytes([min(len(message), 15) << 4]) + (b"\xff" * (rest // 255) + bytes([rest % 255]) if rest >= 0 else b"")
    return b"\x11\0\0\0" + length + message


def message_of(request: dict) -> dict:
    """The wire fields of a request with its timers inside: one dictionary, timer tags laid end to end."""
    words: dict[str, int] = {}
    at = lambda word: words.setdefault(word, len(words))
    tags = [(at(t["name"]), at(t["value"])) for t in request["tags"]]
    timers = request["timers"]
    of_timers = [(at(t["name"]), at(t["value"])) for timer in timers for t in timer["tags"]]
    return {
        "hostname": request["host"], "server_name": request["server"], "script_name": request["script"], "schema": request["schema"], "status": int(request["status"]),
        "request_count": 1, "memory_peak": 0, "document_size": request["traffic"], "memory_footprint": request["mem_used"],
        "request_time": request["request_time_ns"] / 1e9, "ru_utime": request["ru_utime_ns"] / 1e9, "ru_stime": request["ru_stime_ns"] / 1e9,
        "timer_hit_count": [t["hit_count"] for t in timers], "timer_value": [t["value_ns"] / 1e9 for t in timers], "timer_tag_count": [len(t["tags"]) for t in timers],
        "timer_ru_utime": [t["ru_utime_ns"] / 1e9 for t in timers], "timer_ru_stime": [t["ru_stime_ns"] / 1e9 for t in timers],
        "timer_tag_name": [n for n, _ in of_timers], "timer_tag_value": [v for _, v in of_timers], "tag_name": [n for n, _ in tags], "tag_value": [v for _, v in tags], "dictionary": list(words),
    }
