"""Operator 4: sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: a
permutation given by an offset and a skip from hashes of its name. Shards take
turns claiming their next free slot until all are taken, so shares differ by at
most one slot for each unit of weight, and a shard that joins or leaves moves
few slots. The table has a fixed size, so it is broadcast; a row's place is one
hash and one lookup, without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from panelforge.llm.common import read

#: Slots, a prime well above 100 a shard, and the shards of the registered query.
SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{salt}:{name}".encode(), digest_size=8).digest(), "big")


def fill(shards: tuple[str, ...], slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """Index of the shard that owns each slot; a shard of weight w claims w slots a turn.

    Shards take their turns in the order of their names, whatever the order given.
    """
    if not shards:
        raise ValueError("no shards")
    if len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shard names repeat, or there are more shards than slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    turns = [i for i in sorted(range(len(shards)), key=lambda i: shards[i]) for _ in range((weights or {}).get(shards[i], 1))]
    at = {i: _hash(shards[i], "offset") % slots for i in turns}
    skip = {i: _hash(shards[i], "skip") % (slots - 1) + 1 for i in turns}
    owner, left = [-1] * slots, slots
    while left:
        for i in turns:
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]] = i
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key; a null key has the empty text's slot."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(docs: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard_slot`` and ``shard``.

    Equal keys go to one shard; repeated rows stay. Columns of ``docs`` that
    already have one of the two names are replaced. An empty table gives none.
    """
    owners = fill(shards, slots, weights)
    table = docs.sparkSession.createDataFrame([(i, shards[o]) for i, o in enumerate(owners)], "shard_slot int, shard string")
    rest = docs.drop("shard_slot", "shard").withColumn("shard_slot", slot_of(F.col(key), slots))
    # exactly `slots` rows, whatever the input's size
    return rest.join(F.broadcast(table), "shard_slot").select(*[c for c in docs.columns if c not in ("shard_slot", "shard")], "shard_slot", "shard")


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's shard; null ids share the empty key's shard, repeated rows get a row each."""
    return place(read(spark, sf_dir, "documents").select("doc_id"))
