"""Placement on shards by a lookup table of prime size that the shards fill in turns.

Each shard has a preference order over all slots, given by an offset and a step taken from hashes of its name.  The
shards take turns, in the order given, and each turn claims the shard's next preferred slot that is still free.  The
shards' shares differ by one slot at most, and a change of the shards moves few keys between those that stay.
The table has ``slots`` rows whatever the data, so it is broadcast; a key is placed by one hash and one lookup.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime over a hundred times the number of shards below.
SLOTS = 4099
SHARDS = tuple(f"shard-{i:02d}" for i in range(32))
#: No table larger than this is broadcast.
MOST_SLOTS = 2_000_003


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: Sequence[str], slots: int) -> list[str]:
    """The shard of each slot.  Settings only: no data reaches this function."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be some, and their names must differ")
    if not _prime(slots) or slots < len(shards) or slots > MOST_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    digests = [hashlib.md5(s.encode()).hexdigest() for s in shards]
    place = [int(d[:15], 16) % slots for d in digests]
    step = [int(d[15:30], 16) % (slots - 1) + 1 if slots > 2 else 1 for d in digests]
    table: list[str | None] = [None] * slots
    free = slots
    while True:
        for i, shard in enumerate(shards):
            while table[place[i]] is not None:
                place[i] = (place[i] + step[i]) % slots
            table[place[i]] = shard
            free -= 1
            if not free:
                return table


def lookup_table(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The filled table as rows (slot, shard)."""
    number = {s: i for i, s in enumerate(shards)}
    names = F.array(*[F.lit(s) for s in shards])
    filled = F.split(F.lit(",".join(str(number[s]) for s in fill(shards, slots))), ",")
    rows = spark.range(1).select(F.posexplode(filled).alias("slot", "number"))
    return rows.select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("number").cast("int") + 1).alias("shard"))


def slot_of(key: str | Column, slots: int = SLOTS) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text, modulo the table's size.  A null key counts as empty text."""
    column = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots


def place(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` of each row's key, without a shuffle.

    Equal keys, repeated rows and ties share a shard; null keys are placed as the empty text; an empty table stays
    empty.  Columns named ``slot`` or ``shard`` are replaced.
    """
    table = lookup_table(df.sparkSession, shards, slots)
    rows = df.select(*[df[c] for c in df.columns if c not in ("slot", "shard")], slot_of(df[key], slots).alias("slot"))
    return rows.join(F.broadcast(table), "slot").select(*[c for c in rows.columns if c != "slot"], "slot", "shard")
