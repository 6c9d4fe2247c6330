"""Variable-length and fixed little-endian integers as binary columns, in built-in functions.

Unsigned 64-bit values travel as longs in two's complement; ``unsigned`` shows them as decimals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def byte_hex(n: Column) -> Column:
    return F.lpad(F.hex(n), 2, "0")


def varint_len(n: Column) -> Column:
    """Bytes that the varint of an unsigned 64-bit value takes: one for each seven bits."""
    out = F.when(n < 0, 10)
    for k in range(1, 9):
        out = out.when(n < (1 << 7 * k), k)
    return out.otherwise(9).cast("int")


def _hex_of(n: Column, size: int) -> Column:
    return F.lpad(F.hex(n), 2 * size, "0")


def _or(parts: Iterable[Column]) -> Column:
    return reduce(Column.bitwiseOR, parts)


#: The top bit of each of eight bytes, as a long.
TOPS = 0x8080808080808080 - (1 << 64)


def encode_varint(n: Column) -> Column:
    """Seven bits a byte, least first; the top bit says that more follow. The first eight bytes are one long, so a row takes no array."""
    n = n.cast("long")
    size = varint_len(n)
    bits = _or(F.shiftleft(F.shiftrightunsigned(n, 7 * i).bitwiseAND(F.lit(127)), 56 - 8 * i) for i in range(8))
    follow = F.when(size > 8, F.lit(TOPS)).otherwise(F.shiftleft(F.call_function("shiftleft", F.lit(-1).cast("long"), F.lit(71) - 8 * size), 1).bitwiseAND(F.lit(TOPS)))
    head = _hex_of(bits.bitwiseOR(follow), 8)
    ninth = F.shiftrightunsigned(n, 56).bitwiseAND(F.lit(127))
    tenth = F.shiftleft(ninth.bitwiseOR(F.lit(128)), 8).bitwiseOR(F.shiftrightunsigned(n, 63))
    return F.unhex(F.when(size <= 8, F.substr(head, F.lit(1), 2 * size)).when(size == 9, F.concat(head, _hex_of(ninth, 1))).otherwise(F.concat(head, _hex_of(tenth, 2))))


def byte_at(data: Column, i: Column) -> Column:
    """Byte ``i`` (from 0) as a number."""
    return F.conv(F.hex(F.substr(data, i + 1, F.lit(1))), 16, 10).cast("long")


def decode_varint(data: Column, most: int = 10) -> Column:
    """struct(value, consumed) of a varint at the start of ``data``; null if it doesn't end within ``most`` bytes or the data."""
    size = F.least(F.length(data), F.lit(most))

    def number(at: int, n: int) -> Column:
        """``n`` bytes of ``data`` as a long, zeros behind its end."""
        return F.conv(F.rpad(F.hex(F.substring(data, at, n)), 2 * n, "0"), 16, -10).cast("long")

    behind = number(9, 2)

    def used(head: Column) -> Column:
        """The place of the first byte without its top bit."""
        out = F.when(head >= 0, 1)
        for k in range(2, 9):
            out = out.when(head.bitwiseAND(F.lit(0x80 << 64 - 8 * k)) == 0, k)
        return (out.when(behind < 0x8000, 9).when(behind.bitwiseAND(F.lit(0x80)) == 0, 10) if most > 8 else out).otherwise(most + 1)

    def read(head: Column, n: Column) -> Column:
        mine = head.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), F.greatest(F.lit(64) - 8 * n, F.lit(0))))
        value = _or(F.shiftleft(F.shiftrightunsigned(mine, 56 - 8 * i).bitwiseAND(F.lit(127)), 7 * i) for i in range(min(most, 8)))
        if most > 8:
            ninth = value.bitwiseOR(F.shiftleft(F.shiftright(behind, 8).bitwiseAND(F.lit(127)), 56))
            tenth = ninth.bitwiseOR(F.shiftleft(behind.bitwiseAND(F.lit(127)), 63))
            value = F.when(n <= 8, value).when(n == 9, ninth).otherwise(tenth)
        value = value.bitwiseAND(F.lit(0xFFFFFFFF)) if most == 5 else value
        return F.when(n <= size, F.struct(value.alias("value"), n.alias("consumed")))

    first = byte_at(data, F.lit(0))
    alone = F.struct(first.alias("value"), F.lit(1).alias("consumed"))  # most are one byte, which needs no more
    longer = let(number(1, 8), lambda head: let(used(head), lambda n: read(head, n)))
    return F.when(first < 128, alone).otherwise(longer)


def encode_fixed(n: Column, size: int) -> Column:
    """``size`` bytes, least first."""
    digits = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 17 - 2 * (i + 1), 2) for i in range(size)]))


def decode_fixed(data: Column, size: int) -> Column:
    """The number at the start of ``data``, as decimal(20, 0); null if it is short."""
    digits = F.hex(F.substring(data, 1, size))
    back = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.when(F.length(data) >= size, F.conv(back, 16, 10).cast("decimal(20,0)"))


def unsigned(n: Column) -> Column:
    """A long in two's complement as the unsigned decimal."""
    return F.when(n < 0, n.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(n.cast("decimal(20,0)")).cast("decimal(20,0)")
