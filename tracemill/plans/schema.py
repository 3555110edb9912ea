"""Schemas of the trace tables and the coding of statement ids."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Formats of the wire, by code.
FORMATS = ("UNSIGNED", "SIGNED", "FLOAT", "POINTER", "BLOB", "INVALID")

NUM = T.DecimalType(20, 0)  # holds every signed and unsigned 64-bit integer
VAR = T.StructType(
    [
        T.StructField("pos", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("num", NUM),  # UNSIGNED, SIGNED and POINTER
        T.StructField("dbl", T.DoubleType()),  # FLOAT
        T.StructField("blob", T.BinaryType()),  # BLOB
        T.StructField("buffer_size", NUM),  # of a pointer into a known allocation, else null
    ]
)
ALLOCATION = T.StructType([T.StructField("address", NUM), T.StructField("size", NUM)])
POINTS = T.StructType(
    [
        T.StructField("trace_id", T.LongType()),
        T.StructField("counter", T.LongType()),
        T.StructField("statement", T.LongType()),  # the 64 bits as they are
        T.StructField("sizes", T.ArrayType(ALLOCATION)),
        T.StructField("vars", T.ArrayType(VAR)),
        T.StructField("aux", T.ArrayType(T.LongType())),
    ]
)
TYPES = T.StructType([T.StructField("trace_id", T.LongType()), T.StructField("type_idx", T.IntegerType()), T.StructField("type_name", T.StringType()), T.StructField("format", T.StringType()), T.StructField("size", T.IntegerType())])
TRACES = T.StructType(
    [
        T.StructField("trace_id", T.LongType()),
        T.StructField("load", T.StringType()),  # traces of one load have consecutive ids; loads are ordered by it
        T.StructField("source", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

#: A statement id with bit 63 set holds a file id of 23 bits above a node id of 40.
FLAG = -(1 << 63)
NODE_BITS, FILE_BITS = 40, 23
NODE_MASK, FILE_MASK = (1 << NODE_BITS) - 1, (1 << FILE_BITS) - 1


def stmt_id(statement: Column) -> Column:
    """The node id of a flagged statement, else the statement itself."""
    return F.when(statement < 0, statement.bitwiseAND(F.lit(NODE_MASK))).otherwise(statement)


def file_id(statement: Column) -> Column:
    """The file id of a flagged statement, else null."""
    return F.when(statement < 0, F.shiftrightunsigned(statement, NODE_BITS).bitwiseAND(F.lit(FILE_MASK)))


def encode_statement(file: Column, node: Column) -> Column:
    return F.lit(FLAG).bitwiseOR(F.shiftleft(file.cast("long"), NODE_BITS)).bitwiseOR(node)


def mask_ranges(mask: int, value: int) -> tuple[list[tuple[int, int]], bool]:
    """Ranges of signed statements that hold all s with s & mask == value, and whether they hold no others.

    The mask's ones from bit 62 down, as far as they go on, bound a range for either value of bit 63 that it leaves open.
    """
    m, v = mask % (1 << 64), value % (1 << 64)
    if v & ~m:
        return [], True
    free = 63
    while free and m >> (free - 1) & 1:
        free -= 1
    rest = (1 << free) - 1
    high = v & ~rest & ((1 << 63) - 1)
    signs = [FLAG, 0] if not m >> 63 else [FLAG if v >> 63 else 0]
    return [(sign + high, sign + high + rest) for sign in signs], not m & rest


def masked(statement: Column, mask: int, value: int) -> Column:
    """mask and value as signed 64-bit integers. Ranges come first, which Parquet's statistics can skip by; then the bits, where ranges don't say all."""
    ranges, exact = mask_ranges(mask, value)
    found = F.lit(False)
    for low, high in ranges:
        found = found | ((statement >= low) & (statement <= high)) if low > FLAG or high < ~FLAG else F.lit(True)
    return found if exact else found & (statement.bitwiseAND(F.lit(mask)) == F.lit(value))


def in_file(statement: Column, file: int, strict: bool = False) -> Column:
    """Statements of a file; by bits alone, as unflagged ones have file 0, or strictly flagged ones."""
    flag = FLAG if strict else 0
    return masked(statement, flag | FILE_MASK << NODE_BITS, flag | file << NODE_BITS)


def unsigned(bits: Column) -> Column:
    """The unsigned value of 64 bits kept in a long."""
    wide = bits.cast(NUM)
    return F.when(bits < 0, (wide + F.lit(Decimal(1 << 64)).cast(NUM)).cast(NUM)).otherwise(wide)


def bits(number: Column) -> Column:
    """The 64 bits of an unsigned or signed integer, in a long."""
    return F.when(number > F.lit(Decimal((1 << 63) - 1)), number - F.lit(Decimal(1 << 64))).otherwise(number).cast("long")


def blob_text(blob: Column) -> Column:
    """The text of a blob, null where it isn't UTF-8: its bytes are then all there is."""
    return F.try_validate_utf8(blob.cast("string"))
