"""Codecs between typed columns and ordered bytes, as column expressions."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from nestwell.errors import DecodeError

_SIGN = -(2**63)


def successor(prefix: bytes) -> bytes | None:
    """The least key above all that begin with ``prefix``; None when there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def to_bytes(value: bytes | bytearray | memoryview | str) -> bytes:
    return value.encode("utf-8") if isinstance(value, str) else bytes(value)


class KeyCodec(Protocol):
    """``encode``/``decode`` work on columns, ``pack``/``unpack`` on Python values; both agree byte for byte."""

    order_preserving: bool

    def encode(self, col: Column) -> Column: ...
    def decode(self, col: Column) -> Column: ...
    def pack(self, value: Any) -> bytes: ...
    def unpack(self, data: bytes) -> Any: ...


def _eight(hexed: Column) -> Column:
    return F.unhex(F.lpad(hexed, 16, "0"))


def _exact(col: Column, n: int, value: Column, what: str) -> Column:
    return F.when(F.length(col) == n, value).when(col.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit(f"{what}: {n} bytes expected")))


@dataclass(frozen=True)
class U64:
    """Unsigned 64-bit, big-endian: bytes order like numbers. Columns are BIGINT or DECIMAL(20,0)."""

    order_preserving = True
    numeric = True
    sql_type = "decimal(20,0)"

    def encode(self, col: Column) -> Column:
        return _eight(F.conv(col.cast("decimal(20,0)").cast("string"), 10, 16))

    def decode(self, col: Column) -> Column:
        return _exact(col, 8, F.conv(F.hex(col), 16, 10).cast("decimal(20,0)"), "u64")

    def pack(self, value: int) -> bytes:
        return struct.pack(">Q", value)

    def unpack(self, data: bytes) -> int:
        if len(data) != 8:
            raise DecodeError("u64: 8 bytes expected")
        return struct.unpack(">Q", data)[0]


@dataclass(frozen=True)
class I64Key:
    """Signed 64-bit keys: big-endian with the sign bit flipped, so that negative numbers come first."""

    order_preserving = True
    sql_type = "bigint"

    def encode(self, col: Column) -> Column:
        return _eight(F.hex(col.cast("long").bitwiseXOR(F.lit(_SIGN))))

    def decode(self, col: Column) -> Column:
        return _exact(col, 8, _signed(col).bitwiseXOR(F.lit(_SIGN)), "i64")

    def pack(self, value: int) -> bytes:
        return struct.pack(">Q", value + 2**63)

    def unpack(self, data: bytes) -> int:
        if len(data) != 8:
            raise DecodeError("i64: 8 bytes expected")
        return struct.unpack(">Q", data)[0] - 2**63


@dataclass(frozen=True)
class I64Value:
    """Signed 64-bit values: plain big-endian two's complement, without the flip that keys have."""

    order_preserving = False
    numeric = True
    sql_type = "bigint"

    def encode(self, col: Column) -> Column:
        return _eight(F.hex(col.cast("long")))

    def decode(self, col: Column) -> Column:
        return _exact(col, 8, _signed(col), "i64")

    def pack(self, value: int) -> bytes:
        return struct.pack(">q", value)

    def unpack(self, data: bytes) -> int:
        if len(data) != 8:
            raise DecodeError("i64: 8 bytes expected")
        return struct.unpack(">q", data)[0]


def _signed(col: Column) -> Column:
    """Eight bytes as a signed number: the high and the low half each fit a BIGINT."""
    half = lambda at: F.conv(F.hex(F.substring(col, at, 4)), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(5))


@dataclass(frozen=True)
class Utf8:
    order_preserving = True
    sql_type = "string"

    def encode(self, col: Column) -> Column:
        return F.encode(col, "UTF-8")

    def decode(self, col: Column) -> Column:
        return F.when(col.isNull() | F.is_valid_utf8(col.cast("string")), col.cast("string")).otherwise(F.raise_error(F.lit("string: invalid UTF-8")))

    def pack(self, value: str) -> bytes:
        return value.encode("utf-8")

    def unpack(self, data: bytes) -> str:
        try:
            return bytes(data).decode("utf-8")
        except UnicodeDecodeError as e:
            raise DecodeError(str(e)) from e


@dataclass(frozen=True)
class Raw:
    order_preserving = True
    sql_type = "binary"

    def encode(self, col: Column) -> Column:
        return col.cast("binary")

    def decode(self, col: Column) -> Column:
        return col

    def pack(self, value: bytes) -> bytes:
        return to_bytes(value)

    def unpack(self, data: bytes) -> bytes:
        return bytes(data)


@dataclass(frozen=True)
class StringPair:
    """Two strings as one ordered key: NUL becomes 00 FF, each part ends with 00 00. Keys only."""

    order_preserving = True
    sql_type = "struct<a: string, b: string>"

    def _part(self, col: Column) -> Column:
        pairs = F.regexp_extract_all(F.hex(F.encode(col, "UTF-8")), F.lit("(..)"), F.lit(1))
        return F.concat(F.array_join(F.transform(pairs, lambda x: F.when(x == "00", "00FF").otherwise(x)), ""), F.lit("0000"))

    def encode(self, col: Column) -> Column:
        return F.unhex(F.concat(self._part(col["a"]), self._part(col["b"])))

    def decode(self, col: Column) -> Column:
        """Bytes as hex pairs; an escape or end is recognised at even places only, so the strict form is one pattern."""
        spaced = F.regexp_replace(F.hex(col), "(..)", "$1 ")
        shape = r"^((?:(?!00 )..\x20|00 FF )*)00 00 ((?:(?!00 )..\x20|00 FF )*)00 00 $"
        text = lambda k: F.unhex(F.replace(F.replace(F.regexp_extract(spaced, shape, k), F.lit("00 FF "), F.lit("00 ")), F.lit(" "), F.lit(""))).cast("string")
        return F.when(col.isNull(), F.lit(None)).when(spaced.rlike(shape), F.struct(text(1).alias("a"), text(2).alias("b"))).otherwise(F.raise_error(F.lit("pair: malformed")))

    def pack(self, value: tuple[str, str]) -> bytes:
        return b"".join(v.encode("utf-8").replace(b"\0", b"\0\xff") + b"\0\0" for v in value)

    def unpack(self, data: bytes) -> tuple[str, str]:
        parts, at, out = [], 0, bytearray()
        while at < len(data):
            if data[at]:
                out.append(data[at])
                at += 1
                continue
            after = data[at + 1 : at + 2]
            if after == b"\xff":
                out.append(0)
            elif after == b"\0":
                parts.append(Utf8().unpack(bytes(out)))
                out = bytearray()
            else:
                raise DecodeError("pair: invalid escape")
            at += 2
        if out or len(parts) != 2:
            raise DecodeError("pair: trailing bytes or unterminated part")
        return parts[0], parts[1]


@dataclass(frozen=True)
class MessagePack:
    """Nested Python values in MessagePack's compact form. Opaque to SQL: columns pass through as bytes."""

    order_preserving = False
    sql_type = "binary"

    def encode(self, col: Column) -> Column:
        return col.cast("binary")

    def decode(self, col: Column) -> Column:
        return col

    def pack(self, value: Any) -> bytes:
        return _pack(value)

    def unpack(self, data: bytes) -> Any:
        value, at = _unpack(bytes(data), 0)
        if at != len(data):
            raise DecodeError("messagepack: trailing bytes")
        return value


def _sized(n: int, small: int | None, limit: int, codes: dict[int, int]) -> bytes:
    if small is not None and n < limit:
        return bytes([small | n])
    for width, code in codes.items():
        if n < 1 << (8 * width):
            return bytes([code]) + n.to_bytes(width, "big")
    raise ValueError("messagepack: too long")


def _pack(v: Any) -> bytes:
    if v is None or isinstance(v, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[v]
    if isinstance(v, int):
        if 0 <= v:
            return _sized(v, 0x00, 128, {1: 0xCC, 2: 0xCD, 4: 0xCE, 8: 0xCF})
        if v >= -32:
            return struct.pack("b", v)
        width, code = next((w, c) for w, c in ((1, 0xD0), (2, 0xD1), (4, 0xD2), (8, 0xD3)) if v >= -(1 << (8 * w - 1)))
        return bytes([code]) + v.to_bytes(width, "big", signed=True)
    if isinstance(v, float):
        return b"\xcb" + struct.pack(">d", v)
    if isinstance(v, str):
        data = v.encode("utf-8")
        return _sized(len(data), 0xA0, 32, {1: 0xD9, 2: 0xDA, 4: 0xDB}) + data
    if isinstance(v, (bytes, bytearray)):
        return _sized(len(v), None, 0, {1: 0xC4, 2: 0xC5, 4: 0xC6}) + bytes(v)
    if isinstance(v, (list, tuple)):
        return _sized(len(v), 0x90, 16, {2: 0xDC, 4: 0xDD}) + b"".join(map(_pack, v))
    if isinstance(v, dict):
        return _sized(len(v), 0x80, 16, {2: 0xDE, 4: 0xDF}) + b"".join(_pack(k) + _pack(x) for k, x in v.items())
    raise TypeError(f"messagepack: {type(v).__name__}")


def _unpack(d: bytes, at: int) -> tuple[Any, int]:
    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(d):
            raise DecodeError("messagepack: truncated")
        at += n
        return d[at - n : at]

    def size(n: int) -> int:
        return int.from_bytes(take(n), "big")

    def several(n: int) -> list:
        nonlocal at
        out = []
        for _ in range(n):
            v, at = _unpack(d, at)
            out.append(v)
        return out

    def pairs(n: int) -> dict:
        flat = several(2 * n)
        return dict(zip(flat[::2], flat[1::2], strict=True))

    c = take(1)[0]
    if c < 0x80 or c >= 0xE0:
        return (c if c < 0x80 else c - 256), at
    if c < 0xC0:
        v = pairs(c & 15) if c < 0x90 else several(c & 15) if c < 0xA0 else take(c & 31).decode("utf-8")
        return v, at
    if c in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[c], at
    if 0xC4 <= c <= 0xC6:
        return take(size(1 << (c - 0xC4))), at
    if c in (0xCA, 0xCB):
        return struct.unpack(">f" if c == 0xCA else ">d", take(4 if c == 0xCA else 8))[0], at
    if 0xCC <= c <= 0xD3:
        return int.from_bytes(take(1 << ((c - 0xCC) % 4)), "big", signed=c >= 0xD0), at
    if 0xD9 <= c <= 0xDB:
        return take(size(1 << (c - 0xD9))).decode("utf-8"), at
    if c in (0xDC, 0xDD, 0xDE, 0xDF):
        n = size(2 if c % 2 == 0 else 4)
        return (several(n) if c < 0xDE else pairs(n)), at
    raise DecodeError(f"messagepack: code {c:#x}")
