"""Whether values are in a master list: exactly by a join, or by a Bloom filter whose bits any tool can check."""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a filter's file begins with, unless the caller names something else.
MARK = b"BLOM"


def normal(c: Column) -> Column:
    return F.upper(F.trim(c))


def master_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(value): the distinct values of columns, normalised, without blanks and not-a-numbers."""
    one = df.select(F.explode(F.array(*[normal(F.col(c).cast("string")) for c in columns])).alias("value"))
    return one.filter((F.col("value") != "") & (F.col("value") != "NAN")).distinct()


def known(df: DataFrame, column: str, master: DataFrame | None, into: str = "_known") -> DataFrame:
    """df with a boolean: true, false, or null for a blank value or without a master list.

    The join's plan is Catalyst's: a small list is broadcast by its size, a large one shuffled.
    """
    if master is None:
        return df.withColumn(into, F.lit(None).cast("boolean"))
    own = master.select(F.col("value").alias("_value"), F.lit(True).alias("_hit")).distinct()
    joined = df.join(own, normal(F.col(column)) == F.col("_value"), "left")
    return joined.withColumn(into, F.when(F.trim(F.col(column)) != "", F.coalesce("_hit", F.lit(False)))).drop("_value", "_hit")


def sizes(n: int, rate: float = 0.001) -> tuple[int, int]:
    """Bits and hashes of a filter for n values at a rate of false positives."""
    n = max(n, 1)
    m = max(8, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return m, max(1, round(m / n * math.log(2)))


def bit_places(value: str, m: int, k: int) -> list[int]:
    """Double hashing with the halves of a SHA-256."""
    digest = hashlib.sha256(value.encode()).digest()
    h1, h2 = int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:16], "big")
    return [(h1 + i * h2) % m for i in range(k)]


class Bloom:
    def __init__(self, m: int, k: int, bits: bytearray | None = None):
        self.m, self.k, self.bits = m, k, bits if bits is not None else bytearray((m + 7) // 8)

    def add(self, value: str) -> None:
        for p in bit_places(value, self.m, self.k):
            self.bits[p // 8] |= 1 << p % 8

    def __contains__(self, value: str) -> bool:
        return all(self.bits[p // 8] >> p % 8 & 1 for p in bit_places(value, self.m, self.k))

    def to_bytes(self, mark: bytes = MARK) -> bytes:
        return mark + struct.pack("<HQI", 1, self.m, self.k) + bytes(self.bits)

    @classmethod
    def from_bytes(cls, data: bytes, mark: bytes = MARK) -> Bloom:
        n = len(mark)
        if data[:n] != mark or struct.unpack_from("<H", data, n)[0] != 1:
            raise ValueError("not a filter of this format")
        m, k = struct.unpack_from("<QI", data, n + 2)
        return cls(m, k, bytearray(data[n + 14 :]))

    @classmethod
    def of(cls, values: Iterable[str], n: int, rate: float = 0.001) -> Bloom:
        out = cls(*sizes(n, rate))
        for v in values:
            out.add(v)
        return out


#: Bytes of a filter that come to the driver as one row.
_SLICE = 4096


def build_bloom(master: DataFrame, rate: float = 0.001) -> Bloom:
    """A filter of master (value), its bits set by the executors: of each slice of the filter one row, with its bytes that
    are not zero, comes to the driver, one partition of slices at a time. The driver holds the filter, 1.8 bytes a value."""
    n = master.count()
    m, k = sizes(n, rate)
    places = master.filter(F.col("value").isNotNull()).select(F.explode(F.array(*[native_place(F.col("value"), m, i) for i in range(k)])).alias("p"))
    one = places.groupBy(F.expr("p div 8").alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(p % 8 as int))")).alias("bits"))
    slices = one.groupBy(F.expr(f"at div {_SLICE}").alias("slice")).agg(F.collect_list(F.struct("at", "bits")).alias("bytes"))
    out = Bloom(m, k)
    for row in slices.toLocalIterator():
        for at, bits in row["bytes"]:
            out.bits[at] |= bits
    return out


def maybe_known(c: Column, bloom: Bloom) -> Column:
    """Membership by a filter; null for blank values. The filter is as large as its list wants, 1.8 bytes a value."""

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or not v.strip() else v.strip().upper() in bloom)

    return test(c)


def confirmed(df: DataFrame, column: str, bloom: Bloom, master: DataFrame, into: str = "_known") -> DataFrame:
    """df with a boolean as `known` gives it: what the filter denies is not there, what it may know is looked up in master.

    master (value): the normalised values that the filter was built of.
    """
    own = master.select(F.col("value").alias("_value"), F.lit(True).alias("_hit")).distinct()
    told = df.withColumn("_maybe", maybe_known(F.col(column), bloom))
    joined = told.join(own, (normal(F.col(column)) == F.col("_value")) & F.col("_maybe"), "left")
    return joined.withColumn(into, F.when(F.col("_maybe"), F.coalesce("_hit", F.lit(False))).otherwise(F.col("_maybe"))).drop("_value", "_hit", "_maybe")


def first_hash(c: Column) -> Column:
    """The first 64 bits of a value's SHA-256 as a decimal, with built-in functions."""
    return F.conv(F.left(F.sha2(c, 256), F.lit(16)), 16, 10).cast("decimal(38,0)")


def native_place(c: Column, m: int, i: int) -> Column:
    h1, h2 = (F.conv(F.substring(F.sha2(c, 256), at, 16), 16, 10).cast("decimal(38,0)") for at in (1, 17))
    return ((h1 + F.lit(i).cast("decimal(10,0)") * h2) % F.lit(m).cast("decimal(20,0)")).cast("long")
