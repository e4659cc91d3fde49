"""Placement of keys on shards by a permutation-filled lookup table.

Each shard has a preference order of all slots of a prime-sized table (a start and a step from
digests of its name). The shards take turns; in its turn a shard claims the first slot of its order
that is free. The table depends on the shards' names and its size alone, so it is filled on the
driver and broadcast (size rows, a parameter), and a key is placed by one lookup. Removing a shard
moves the keys that it had and few others.

Everything over the rows is a DataFrame expression. A null key has a null slot and shard. Equal
keys have equal places, repeated rows stay, extra columns pass through, and columns named slot and
shard are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

#: The production parameters: slots of the table (a prime, over 100 for each shard) and shards.
SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def number(text: str) -> int:
    """The first 60 bits of a string's MD5."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The position in `shards` of each slot's owner."""
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"the table's size must be a prime: {slots}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("there must be shards, of different names and no more than slots")
    at = [number(f"{s}/start") % slots for s in shards]
    step = [number(f"{s}/step") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            slot = at[i]
            while table[slot] >= 0:
                slot = (slot + step[i]) % slots
            table[slot] = i
            at[i] = (slot + step[i]) % slots
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digest = F.substring(F.md5(F.encode(key.cast("string"), "UTF-8")), 1, 15)
    return F.conv(digest, 16, 10).cast("long") % F.lit(slots)


def place(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with the slot (long) and shard (string) of each row's key."""
    session = df.sparkSession
    owners = fill(shards, slots)
    listed = F.split(F.lit(",".join(map(str, owners))), ",")
    owner = session.range(slots).select(F.col("id").alias("_slot"), F.element_at(listed, (F.col("id") + 1).cast("int")).cast("int").alias("_owner"))
    names = F.split(F.lit("\n".join(shards)), "\n")
    owner = owner.select("_slot", F.element_at(names, F.col("_owner") + 1).alias("shard"))
    rows = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return rows.join(F.broadcast(owner), F.col("slot") == F.col("_slot"), "left").drop("_slot")


def placement_sql(table: str, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> str:
    """DuckDB SQL of place(): key, slot, shard."""
    owners = fill(shards, slots)
    names = ",".join(f"'{s}'" for s in shards)
    return f"""
    WITH t AS (SELECT [{names}] AS names, string_split('{",".join(map(str, owners))}', ',') AS owners),
    k AS (SELECT {key}, CAST(('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 15)) AS BIGINT) % {slots} AS slot FROM {table})
    SELECT {key}, slot, names[CAST(owners[slot + 1] AS INTEGER) + 1] AS shard FROM k, t"""
