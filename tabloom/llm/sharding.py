"""Placement by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a table of prime size
(offset + k * skip); shards take turns, each claiming its next free slot, until
the table is full.  Shards then hold equal parts of the slots (they differ by
one at most), and when a shard leaves few keys of the others move.  The table
has a fixed size, so it is broadcast; a key's place is one hash and one lookup.

Defined results: a null key is hashed like any other value; equal keys have
equal places; an empty table gives an empty result; other columns stay, and
names that clash are refused.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime far above 100 times the shards used; slots, and thus the broadcast, never grow with data.
TABLE_SIZE = 65537


def _hashes(name: str, size: int) -> tuple[int, int]:
    d = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """The shard (its position in ``shards``) of every slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be different, and no more than slots")
    if any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be prime")
    table = np.full(size, -1, np.int32)
    at, skip = (np.array(x, np.int64) for x in zip(*(_hashes(s, size) for s in shards)))
    filled = 0
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            table[at[k]] = k
            filled += 1
            if filled == size:
                return table


def place(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with slot (int) and shard (string)."""
    for c in ("slot", "shard"):
        if c in df.columns:
            raise ValueError(f"the table has a column {c} of its own")
    spark = df.sparkSession
    table = spark.createDataFrame([(i, shards[k]) for i, k in enumerate(lookup_table(shards, size).tolist())], "slot int, shard string")
    keyed = df.withColumn("slot", F.pmod(F.xxhash64(key), F.lit(size)).cast("int"))
    return keyed.join(F.broadcast(table), "slot").select(*df.columns, "slot", "shard")
