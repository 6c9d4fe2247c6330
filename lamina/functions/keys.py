"""Scalar functions over keys and versions: tags, encoded entries and their sizes, separators, successors, shared prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.model import MAX_SEQUENCE, ValueType

from .varint import byte_at, decode_varint, encode_fixed, encode_varint, let, varint_len


def pack_tag(seq: Column, value_type: Column) -> Column:
    """(sequence << 8) | type as a long; sequences of 2**55 on make it negative."""
    return F.shiftleft(seq.cast("long"), 8).bitwiseOR(value_type.cast("long"))


def tag_sequence(tag: Column) -> Column:
    return F.shiftrightunsigned(tag, 8)


def tag_type(tag: Column) -> Column:
    return tag.bitwiseAND(F.lit(255)).cast("int")


def entry_size(key: Column, value: Column) -> Column:
    """What a version counts for in memory: key, tag, type and value."""
    return (F.octet_length(key) + 9 + F.octet_length(value)).cast("long")


def encoded_key_size(key: Column) -> Column:
    return (varint_len((F.octet_length(key) + 8).cast("long")) + F.octet_length(key) + 8).cast("long")


def encoded_size(key: Column, value: Column) -> Column:
    """Bytes of ``encode_entry``, without building it."""
    return (encoded_key_size(key) + varint_len(F.octet_length(value).cast("long")) + F.octet_length(value)).cast("long")


def encode_key(key: Column, seq: Column, value_type: Column) -> Column:
    """Length of key and tag, key, tag in little-endian order."""
    return F.concat(encode_varint(F.octet_length(key) + 8), key, encode_fixed(pack_tag(seq, value_type), 8))


def encode_entry(key: Column, seq: Column, value_type: Column, value: Column) -> Column:
    return F.concat(encode_key(key, seq, value_type), encode_varint(F.octet_length(value)), value)


def decode_entry(data: Column) -> Column:
    """struct(user_key, seq, value_type, value) of an encoded entry; null if it is short or its type unknown."""

    def byte(at: Column) -> Column:
        return F.lpad(F.hex(F.substr(data, at + 1, F.lit(1))), 2, "0")

    def key(head: Column) -> Column:
        size = head["value"] - 8
        tag = (head["consumed"] + size).cast("int")  # where its eight bytes begin
        fits = (size >= 0) & (tag + 8 <= F.length(data))
        return F.when(fits, F.struct(F.substr(data, head["consumed"] + 1, size.cast("int")).alias("user_key"), tag.alias("tag"), byte(tag).alias("kind")))

    def whole(k: Column) -> Column:
        digits = F.hex(F.substr(data, k["tag"] + 2, F.lit(7)))
        seq = F.conv(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(6, -1, -1)]), 16, 10).cast("long")
        rest = decode_varint(F.substr(data, k["tag"] + 9), 5)

        def ends(r: Column) -> Column:
            at = k["tag"] + 8 + r["consumed"]
            value = F.substr(data, at + 1, r["value"].cast("int"))
            entry = F.struct(k["user_key"].alias("user_key"), seq.alias("seq"), F.conv(k["kind"], 16, 10).cast("int").alias("value_type"), value.alias("value"))
            return F.when(k["kind"].isin("00", "01") & (at + r["value"] <= F.length(data)), entry)

        return let(rest, ends)

    return let(decode_varint(data, 5), lambda head: let(key(head), whole))


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of bytes that two keys share at their start."""
    n = F.least(F.octet_length(a), F.octet_length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(places, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.coalesce(F.get(differ, F.lit(0)) - 1, n).cast("int")


def _bumped(key: Column, i: Column) -> Column:
    """The key up to byte ``i`` (from 0), that byte one larger."""
    return F.concat(F.substr(key, F.lit(1), i), F.unhex(F.lpad(F.hex(byte_at(key, i) + 1), 2, "0")))


def separator(a: Column, b: Column) -> Column:
    """A short key k with a <= k < b: at the first difference, a's byte one larger if that stays below b's; else a."""
    i = shared_prefix(a, b)
    fits = (i < F.least(F.octet_length(a), F.octet_length(b))) & (byte_at(a, i) + 1 < byte_at(b, i))
    return F.when(F.coalesce(fits, F.lit(False)), _bumped(a, i)).otherwise(a)


def successor(key: Column) -> Column:
    """A short key that is no smaller: the first byte below 255 one larger, the rest cut; unchanged if there is none."""
    n = F.octet_length(key)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    i = F.get(F.filter(places, lambda i: byte_at(key, i) < 255), F.lit(0))
    return F.when(i.isNotNull(), _bumped(key, i)).otherwise(key)


def internal_separator(a: Column, seq: Column, value_type: Column, b: Column) -> Column:
    """struct(user_key, seq, value_type): a shortened key stands before all versions of it."""
    k = separator(a, b)
    cut = k != a
    return F.struct(k.alias("user_key"), F.when(cut, F.lit(MAX_SEQUENCE)).otherwise(seq).alias("seq"), F.when(cut, F.lit(int(ValueType.VALUE))).otherwise(value_type).alias("value_type"))


def internal_successor(a: Column, seq: Column, value_type: Column) -> Column:
    k = successor(a)
    cut = k != a
    return F.struct(k.alias("user_key"), F.when(cut, F.lit(MAX_SEQUENCE)).otherwise(seq).alias("seq"), F.when(cut, F.lit(int(ValueType.VALUE))).otherwise(value_type).alias("value_type"))


def resized(key: Column, size: int) -> Column:
    """Cut, or filled with zero bytes."""
    return F.substring(F.concat(key, F.lit(bytearray(size))), 1, size)


def prefix_end(prefix: bytes) -> bytes | None:
    """The first key behind all that begin with ``prefix``; None if there is no such key."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None
