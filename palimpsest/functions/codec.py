"""Revision codec as column expressions: eight big-endian bytes, '_', eight bytes, and 't' for tombstones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def encode(main: Column | str, sub: Column | str, kind: Column | str) -> Column:
    """The 17-byte key of a put, or the 18-byte key of a tombstone (kind 1)."""
    half = lambda c: F.unhex(F.lpad(F.hex(_column(c).cast("long")), 16, "0"))
    mark = F.when(_column(kind) == 1, F.lit(b"t")).otherwise(F.lit(b""))
    return F.concat(half(main), F.lit(b"_"), half(sub), mark)


def decode_status(key: Column | str) -> Column:
    """OK, or the first fault: BadLength, BadSeparator, UnknownMark, NegativeRevision."""
    k = _column(key)
    byte = lambda at: F.hex(F.substring(k, at, 1))
    negative = lambda at: byte(at) >= "80"
    return (
        F.when(k.isNull() | ~F.length(k).isin(17, 18), "BadLength")
        .when(byte(9) != "5F", "BadSeparator")
        .when((F.length(k) == 18) & (byte(18) != "74"), "UnknownMark")
        .when(negative(1) | negative(10), "NegativeRevision")
        .otherwise("OK")
    )


def _number(key: Column, at: int) -> Column:
    return F.when(decode_status(key) == "OK", F.conv(F.hex(F.substring(key, at, 8)), 16, 10).cast("long"))


def decode_main(key: Column | str) -> Column:
    return _number(_column(key), 1)


def decode_sub(key: Column | str) -> Column:
    return _number(_column(key), 10)


def decode_kind(key: Column | str) -> Column:
    k = _column(key)
    return F.when(decode_status(k) == "OK", (F.length(k) == 18).cast("int"))


def display(main: Column | str, sub: Column | str) -> Column:
    """main_sub"""
    return F.concat_ws("_", _column(main).cast("string"), _column(sub).cast("string"))


def shard(key: Column | str, shards: int = 64, seed: int = 0) -> Column:
    """A seeded shard number, for looking at distribution only."""
    return F.pmod(F.xxhash64(_column(key), F.lit(seed)), F.lit(shards)).cast("int")
