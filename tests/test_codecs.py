import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from nestwell.errors import DecodeError
from nestwell.functions.codecs import I64Key, I64Value, MessagePack, Raw, StringPair, U64, Utf8, successor

CASES = [
    (U64(), [0, 1, 255, 256, 2**64 - 1], "decimal(20,0)"),
    (I64Key(), [-(2**63), -2, -1, 0, 1, 2**63 - 1], "bigint"),
    (Utf8(), ["", "a", "aa", "b", "é"], "string"),
    (Raw(), [b"", b"\0", b"\0\1", b"\1"], "binary"),
    (StringPair(), [("a", ""), ("a", "a"), ("a\0", "a"), ("b", "")], "struct<a: string, b: string>"),
]


@pytest.mark.parametrize("codec,values,kind", CASES)
def test_order_and_round_trip(spark, codec, values, kind):
    packed = [codec.pack(v) for v in values]
    assert packed == sorted(set(packed)) and [codec.unpack(p) for p in packed] == values
    from decimal import Decimal

    rows = [(i, Decimal(v) if kind.startswith("dec") else v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", codec.encode(F.col("v")).alias("e"))
    got = df.select("i", "e", codec.decode(F.col("e")).alias("d")).orderBy("e").collect()
    assert [bytes(r.e) for r in got] == packed
    back = [tuple(r.d) if isinstance(r.d, tuple) else bytes(r.d) if kind == "binary" else r.d for r in got]
    assert back == values


def test_value_codec_is_not_flipped(spark):
    assert I64Value().pack(-1) == b"\xff" * 8 and I64Key().pack(-1) == b"\x7f" + b"\xff" * 7
    df = spark.createDataFrame([(-(2**63),), (-1,), (5,)], "v bigint").select(I64Value().decode(I64Value().encode(F.col("v"))).alias("v"))
    assert [r.v for r in df.collect()] == [-(2**63), -1, 5]


@pytest.mark.parametrize("bad", [b"a", b"a\0\0", b"a\0\0b\0\0c", b"a\0\1\0\0b\0\0"])
def test_malformed_pairs(spark, bad):
    with pytest.raises(DecodeError):
        StringPair().unpack(bad)
    with pytest.raises(PySparkException):
        spark.createDataFrame([(bytearray(bad),)], "e binary").select(StringPair().decode(F.col("e"))).collect()


def test_malformed_scalars(spark):
    for codec, bad in ((U64(), b"123"), (I64Key(), b""), (Utf8(), b"\xff")):
        with pytest.raises(DecodeError):
            codec.unpack(bad)
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bytearray(bad),)], "e binary").select(codec.decode(F.col("e"))).collect()


def test_messagepack():
    m = MessagePack()
    for v in [None, True, 0, 127, 128, 70000, 2**40, -1, -33, -40000, 1.5, "x" * 40, b"y", [1, [2]], {"a": {"b": [None]}}, list(range(20))]:
        assert m.unpack(m.pack(v)) == v
    assert m.pack({"a": 1}) == b"\x81\xa1a\x01"
    with pytest.raises(DecodeError):
        m.unpack(m.pack(1) + b"x")
    with pytest.raises(DecodeError):
        m.unpack(b"\xdb\0")


def test_successor():
    keys = [b"", b"a", b"a\xff", b"a\xff\xff", b"b", b"\xff", b"\xff\xff"]
    for p in keys:
        for k in keys + [b"a\0", b"ab"]:
            assert k.startswith(p) == (k >= p and (successor(p) is None or k < successor(p)))
