"""Keys that grow batch by batch, for batches that ask which of theirs are new.

Every batch adds a tier. Two neighbouring tiers of one size become one of the next, as when counting in binary: after n
batches there are about log2(n) tiers, and a key has been written again about as often. A tier is partitioned by a hash
of the key, so a batch reads only the partitions that its own keys fall into.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import names_in, removed, scratch

PART = "key_part"


def part_of(key: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")


def parts_in(rows: DataFrame) -> list[int]:
    """The partitions that rows fall into: at most as many numbers as there are partitions."""
    return sorted(r[0] for r in rows.select(PART).distinct().collect())


@dataclass(frozen=True)
class Tier:
    """What batches `first` to `last` added; of level k, it was made from 2^k batches."""

    first: int
    last: int
    level: int

    @property
    def name(self) -> str:
        return f"batches-{self.first}-{self.last}-level-{self.level}"


class Tiers:
    """`columns` of all batches in the folder `path`; `key` are those that tell rows apart."""

    def __init__(self, spark: SparkSession, path: str, columns: T.StructType, key: Sequence[str], parts: int = 64):
        self.spark, self.path, self.columns, self.key, self.parts = spark, path, columns, list(key), parts

    def written(self) -> list[Tier]:
        """All tiers. One whose writing broke off is the last batch's, which comes again and does not read it."""
        found = [n.split("-") for n in names_in(self.spark, self.path) if n.startswith("batches-")]
        return [Tier(int(n[1]), int(n[2]), int(n[4])) for n in found]

    def before(self, batch: int) -> list[Tier]:
        """The tiers that hold all batches before one, oldest first: those of which none is part of another."""
        chosen: list[Tier] = []
        for tier in sorted(self.written(), key=lambda t: -t.last):
            if tier.last < (chosen[-1].first if chosen else batch):
                chosen.append(tier)
        return chosen[::-1]

    def read(self, tiers: list[Tier]) -> DataFrame:
        schema = T.StructType([*self.columns.fields, T.StructField(PART, T.IntegerType())])
        each = [self.spark.read.schema(schema).parquet(f"{self.path}/{t.name}") for t in tiers]
        return reduce(DataFrame.unionByName, each) if each else self.spark.createDataFrame([], schema)

    def known(self, batch: int, parts: list[int]) -> DataFrame:
        """Rows of earlier batches in some partitions."""
        return self.read(self.before(batch)).where(F.col(PART).isin(parts))

    def add(self, batch: int, rows: DataFrame) -> None:
        """Add a batch's rows; a batch that comes again replaces what it wrote. Tiers that no batch needs any more go."""
        older = self.before(batch)
        made, merged = Tier(batch, batch, 0), []
        while len(older) > len(merged) and older[-1 - len(merged)].level == made.level:
            merged.append(older[-1 - len(merged)])
            made = Tier(merged[-1].first, batch, made.level + 1)
        every = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.columns], part_of(self.key, self.parts).alias(PART))
        if merged:
            every = every.unionByName(self.read(merged))
        every.hint("rebalance", PART).write.mode("overwrite").partitionBy(PART).parquet(f"{self.path}/{made.name}")
        for tier in self.written():
            if tier.last < batch and tier not in older:
                removed(self.spark, f"{self.path}/{tier.name}")

    def absent(self, batch: int, rows: DataFrame, keep) -> DataFrame:
        """Rows whose key no earlier batch had. `keep` writes a table that lives as long as the caller needs the answer."""
        own = keep(rows.withColumn(PART, part_of(self.key, self.parts)), "own-keys")
        known = self.known(batch, parts_in(own)).select(*self.key, PART)
        return own.join(known, [PART, *self.key], "left_anti").drop(PART)
