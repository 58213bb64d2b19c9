"""Operator 1: n-gram Jaccard join and its near-duplicate classes.

Documents link when the Jaccard similarity of their sets of five-word shingles
is at least ``PERCENT`` / 100. The join is exact on 48-bit shingle hashes.

Plan
----
1. ``sets``: one scan gives each document its set size and a key of its set.
   Documents with equal sets form one class and are joined once.
2. Shingles are dealt by hash to buckets, as packed arrays (one row for each
   Arrow batch and bucket). A bucket knows which shingles several sets hold and
   sends each set only those, with their frequency. A link needs about 80 % of
   a set to be shared, so a set with fewer shared shingles leaves here.
3. With shingles in the order (frequency, hash), two linked sets share one of
   the first n - ceil(0.8 n) + 1 (prefix filter). Sets that share a prefix
   shingle and a size band meet in a tile, named by its least member.
4. In a tile, parity bitmaps of 1,024 bits bound the overlap from above: each
   differing bit needs an element of the symmetric difference. Pairs that may
   still reach the overlap, and are not connected yet, are compared by exact
   intersection of sorted arrays. A tile sends a spanning forest of its links.
5. Connected components of the links give the classes.

Scale: a shingle that very many documents hold (a licence line) would put all
its holders into one bucket entry and one tile. Such shingles are found on a
part of every batch, in a list of at most ``HEAVY`` entries; they count as
shared and come last in the order, without being dealt. Which shingles are on
the list changes the cost, never the result. Tiles of more than ``TILE``
members, or of long texts, are cut into blocks, so no task holds a whole hot
group. Each block is first linked within itself and to ``LEADERS`` members of
its tile; only members that are then outside the tile's largest class meet all
blocks. A group of near copies is one class by then, so its work grows with its
size, not with the square. Buckets reach Python as a sorted stream (Spark's sort spills)
and one bucket of about ``BUCKET_SHINGLES`` is held at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.llm.common import connected_components, materialize, mix64, read, shingle_set

PERCENT = 80
WIDTH = 5
#: Shingles for each bucket and in a map task at a time, members and shingles of a tile's block, leaders of a large tile, entries of the heavy list, bits of a bitmap.
BUCKET_SHINGLES = 1_600_000
FLUSH = 600_000
TILE = 2_048
TILE_SHINGLES = 1_000_000
LEADERS = 16
HEAVY = 20_000
BITS = 1_024
LOW48 = np.uint64((1 << 48) - 1)
TOP = np.uint64(48)
PACKED = "bucket long, keys binary, sizes binary, counts binary, tokens binary"
NEVER = 65_535  # the frequency that heavy shingles are given


def least_overlap(n: int, m: int) -> int:
    """Least intersection with which sets of n and m elements link."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def pack48(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _key(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, sample, sampled = [], [], [], 0
        for text in batch.column("text"):
            tokens = shingle_set(text.as_py(), WIDTH) & LOW48
            sizes.append(len(tokens))
            keys.append(_key(tokens) if len(tokens) else None)
            if len(tokens) and sampled < 256:
                sample.append(tokens)
                sampled += 1
        heavy = b""
        if sampled:
            found, counts = np.unique(np.concatenate(sample), return_counts=True)
            often = counts >= max(8, sampled // 50)
            heavy = np.stack([found[often], counts[often].astype(np.uint64)], 1).astype("<u8").tobytes()
        rows = len(sizes)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array([heavy] + [None] * (rows - 1) if rows else [], pa.binary())],
            ["doc_id", "text_key", "n_shingles", "set_key", "heavy"],
        )


def text_key() -> Column:
    """Hash of a text as it stands, to tell rows with one ``doc_id`` apart."""
    return F.xxhash64("text")


def sets(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, n_shingles, set_key, heavy)``; texts that are null or have no word get size 0 and no key."""
    rows = docs.select("doc_id", text_key().alias("text_key"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_sets, "doc_id long, text_key long, n_shingles long, set_key long, heavy binary")


def heavy_shingles(of_sets: DataFrame) -> np.ndarray:
    """Sorted list of at most ``HEAVY`` very frequent shingles, by the counts on the sampled part of each batch."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                rows = np.frombuffer(blob, "<u8").reshape(-1, 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["s", "n"])

    sampled = of_sets.where("length(heavy) > 0").select("heavy").mapInArrow(unpack, "s long, n long")
    found = sampled.groupBy("s").agg(F.sum("n").alias("n")).where("n >= 100").orderBy(F.desc("n"), "s").limit(HEAVY).select("s").collect()
    return np.sort(np.array([r["s"] for r in found], np.uint64))


def _deal(heavy: np.ndarray, buckets: int):
    """Map step: the shingles of up to ``FLUSH`` at a time, packed for each bucket, with each distinct set once."""

    def packed(keys: list, parts: list) -> pa.RecordBatch:
        keys, sizes = np.array(keys, np.int64), np.array([len(p) for p in parts], np.int64)
        tokens, owner = np.concatenate(parts), np.repeat(np.arange(len(keys), dtype=np.int32), sizes)
        bucket = (mix64(tokens) % np.uint64(buckets)).astype(np.int32)
        if len(heavy):  # heavy ones go to a bucket of their set's key
            at = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
            hot = heavy[at] == tokens
            bucket[hot] = -1 - (keys[owner[hot]] % buckets)
        order = np.argsort(bucket, kind="stable")  # owners ascend already
        tokens, owner, bucket = tokens[order], owner[order], bucket[order]
        home = keys % buckets
        out = []
        for to in np.union1d(bucket, home):
            lo, hi = np.searchsorted(bucket, to, "left"), np.searchsorted(bucket, to, "right")
            own, counts = np.unique(owner[lo:hi], return_counts=True)
            here = home == to  # a set's size goes once, by the bucket that bears the number of its group
            out.append((int(to), keys[own].tobytes(), np.stack([keys[here], sizes[here]], 1).tobytes(), counts.astype("<u4").tobytes(), pack48(tokens[lo:hi])))
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "keys", "sizes", "counts", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys, parts, held = set(), [], [], 0
        for batch in batches:
            for text in batch.column("text"):
                tokens = shingle_set(text.as_py(), WIDTH) & LOW48
                if len(tokens) and (key := _key(tokens)) not in seen:
                    seen.add(key)
                    keys.append(key)
                    parts.append(tokens)
                    held += len(tokens)
                    if held >= FLUSH:
                        yield packed(keys, parts)
                        seen, keys, parts, held = set(), [], [], 0
        if keys:
            yield packed(keys, parts)

    return run


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(bucket, its packed rows) from rows sorted by bucket; the rows are views of the batches."""
    now, rows = None, []
    for batch in batches:
        buckets = batch.column("bucket").to_numpy()
        packed = [batch.column(c) for c in ("keys", "sizes", "counts", "tokens")]
        for row in range(batch.num_rows):
            if rows and buckets[row] != now:
                yield now, rows
                rows = []
            now = int(buckets[row])
            rows.append(tuple(c[row].as_buffer() for c in packed))
    if rows:
        yield now, rows


def _joined(rows: list[tuple], at: int, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[at], kind) for r in rows])


def _by_bucket(packed: DataFrame) -> DataFrame:
    return packed.repartition("bucket").sortWithinPartitions("bucket")


def _often(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values that occur twice or more, and how often each does."""
    if not len(tokens):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    order = np.argsort(tokens)
    ranked = tokens[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    del ranked
    runs = np.diff(np.append(starts, len(tokens)))
    shared = runs >= 2
    return order[np.repeat(shared, runs)], np.repeat(np.minimum(runs[shared], NEVER - 1).astype(np.uint64), runs[shared])


def _shared(groups: int):
    """Reduce step, over the rows of a bucket: the shingles that two sets or more hold, as frequency << 48 | hash, packed for groups of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _streams(batches):
            keys, counts = _joined(rows, 0, np.int64), _joined(rows, 2, "<u4").astype(np.int64)
            sizes = b"".join(r[1] for r in rows)
            first = np.zeros(len(keys), bool)  # one copy of each set
            first[np.unique(keys, return_index=True)[1]] = True
            tokens, at, done = np.empty(int(counts[first].sum()), np.uint64), 0, 0
            for r in rows:
                n = len(r[2]) // 4
                part = unpack48(r[3])[np.repeat(first[at : at + n], counts[at : at + n])]
                tokens[done : done + len(part)] = part
                at, done = at + n, done + len(part)
            del rows
            keys, counts = keys[first], counts[first]
            owner = np.repeat(np.arange(len(keys), dtype=np.int32), counts)
            if bucket < 0:
                tokens |= np.uint64(NEVER) << TOP
            else:
                places, often = _often(tokens)
                tokens, owner = tokens[places] | (often << TOP), owner[places]
                del places, often
            counts = np.bincount(owner, minlength=len(keys))
            group = keys % groups
            sets_in = np.argsort(group, kind="stable")
            rank = np.empty(len(keys), np.int32)
            rank[sets_in] = np.arange(len(keys), dtype=np.int32)
            tokens = tokens[np.argsort(rank[owner], kind="stable")]
            sets_in = sets_in[counts[sets_in] > 0]
            cuts = np.flatnonzero(np.diff(group[sets_in])) + 1 if len(sets_in) else []
            ends = np.cumsum(counts[sets_in])
            out = [(bucket, b"", sizes, b"", b"")] if sizes else []
            for lo, hi in zip([0, *cuts], [*cuts, len(sets_in)], strict=True) if len(sets_in) else ():
                own = sets_in[lo:hi]
                some = tokens[(ends[lo - 1] if lo else 0) : ends[hi - 1]]
                out.append((int(group[own[0]]), keys[own].tobytes(), b"", counts[own].astype("<u4").tobytes(), some.astype("<u8").tobytes()))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "keys", "sizes", "counts", "tokens"])

    return run


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the rows of a group of sets, a row for each set that may link: its shared shingles sorted, its prefix, its parity bitmap."""
    for _, rows in _streams(batches):
        size_of = np.unique(np.frombuffer(b"".join(r[1] for r in rows), np.int64).reshape(-1, 2), axis=0)
        named, counts, tokens = _joined(rows, 0, np.int64), _joined(rows, 2, "<u4").astype(np.int64), _joined(rows, 3, "<u8")
        del rows
        if not len(named):
            continue
        own, at = np.unique(named, return_inverse=True)
        own = size_of[np.searchsorted(size_of[:, 0], own)]
        owner = np.repeat(at.astype(np.int32), counts)
        order = np.lexsort((tokens, owner))
        tokens, shared = tokens[order], np.bincount(owner, minlength=len(own))
        del order, owner
        ends = np.cumsum(shared)
        # the shingles that no other set holds come first in the order and take up their part of the prefix
        lengths = own[:, 1] + PERCENT * own[:, 1] // -100 + 1 - (own[:, 1] - shared)
        keep = np.flatnonzero(lengths > 0)
        blobs, prefixes, maps = [], [np.empty(0, np.int64)], []
        for k in keep:
            mine = tokens[ends[k] - shared[k] : ends[k]]
            prefixes.append((mine[: lengths[k]] & LOW48).astype(np.int64))
            mine = np.sort(mine & LOW48)
            blobs.append(pack48(mine))
            odd = np.bincount((mix64(mine) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
            maps.append(np.packbits(odd.astype(np.uint8)).tobytes())
        edges = np.cumsum([len(x) for x in prefixes])
        yield pa.RecordBatch.from_arrays(
            [pa.array(own[keep, 0]), pa.array(own[keep, 1]), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(prefixes))), pa.array(blobs, pa.binary()), pa.array(maps, pa.binary())],
            ["set_key", "n", "prefix", "tokens", "bitmap"],
        )


def size_band(n):
    """Sets that link have sizes in one band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(100 / PERCENT)) + 1e-9).cast("int")


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tile (or pair of its blocks): a spanning forest of the links in it."""
    for batch in batches:
        a, b = [], []
        for row in range(batch.num_rows):
            members = batch.column("members")[row].as_py()
            members.sort(key=lambda m: (m["n"], m["rep"]))
            sizes = np.array([m["n"] for m in members], np.int64)
            reps = [m["rep"] for m in members]
            own = np.array([m["own"] for m in members], bool)
            block = np.array([m["block"] for m in members], np.int64)
            split = block.min() != block.max()
            maps = np.frombuffer(b"".join(m["bitmap"] for m in members), "<u8").reshape(len(members), BITS // 64)
            tokens = [m["tokens"] for m in members]
            shared = np.array([len(t) // 6 for t in tokens], np.int64)
            group = np.unique([m["known"] for m in members], return_inverse=True)[1]  # members of a class that is known need no link
            opened: dict[int, np.ndarray] = {}
            for i in np.flatnonzero(own):
                # sizes ascend, so the partners of i as the smaller set follow it
                hi = np.searchsorted(sizes, 100 * sizes[i] // PERCENT, "right")
                at = np.arange(i + 1, hi)
                at = at[(group[at] != group[i]) & ((block[at] != block[i]) | (not split))]
                if not len(at):
                    continue
                need = -(-PERCENT * (sizes[i] + sizes[at]) // (100 + PERCENT))
                apart = np.bitwise_count(maps[at] ^ maps[i]).sum(1, dtype=np.int64)
                for j in at[(shared[i] + shared[at] - apart) // 2 >= need]:
                    if group[i] == group[j]:
                        continue
                    for k in (i, j):
                        if k not in opened:
                            opened[k] = unpack48(tokens[k])
                    common = len(np.intersect1d(opened[i], opened[j], assume_unique=True))
                    if common >= least_overlap(int(sizes[i]), int(sizes[j])):
                        a.append(reps[i])
                        b.append(reps[j])
                        group[group == group[j]] = group[i]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(docs: DataFrame, of_sets: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between set keys, enough to connect every pair of linked sets."""
    total = of_sets.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(4, math.ceil(total / BUCKET_SHINGLES))
    heavy = heavy_shingles(of_sets)
    dealt = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_deal(heavy, buckets), PACKED)
    back = _by_bucket(dealt).mapInArrow(_shared(buckets), PACKED)
    kept = materialize(_by_bucket(back).mapInArrow(_prefixes, "set_key long, n long, prefix array<long>, tokens binary, bitmap binary"), "jaccard-sets")

    band = size_band(F.col("n"))
    held = kept.select("set_key", band.alias("band"), F.explode("prefix").alias("shingle"))
    placed = held.select("set_key", "shingle", F.explode(F.array(F.struct("band", F.lit(True).alias("own")), F.struct((F.col("band") - 1).alias("band"), F.lit(False).alias("own")))).alias("p"))
    placed = placed.select("set_key", "shingle", "p.band", "p.own")
    hubs = placed.groupBy("shingle", "band").agg(F.min("set_key").alias("hub"), F.max("set_key").alias("last"), F.max("own").alias("own")).where("hub <> last and own").select("shingle", "band", "hub")
    members = materialize(placed.join(hubs, ["shingle", "band"]).select("hub", "band", "set_key", "own").distinct(), "jaccard-tiles")
    size = F.ceil(F.greatest(F.col("m") / TILE, F.col("m") * F.pow(F.lit(100 / PERCENT), F.col("band") + 1) / TILE_SHINGLES))
    blocks = materialize(members.groupBy("hub", "band").agg(F.count("*").alias("m"), F.max("own").alias("any")).where("any and m > 1").select("hub", "band", size.alias("k")), "jaccard-blocks")
    placed = members.join(blocks, ["hub", "band"]).withColumn("block", F.pmod(F.xxhash64("set_key", F.lit(7)), F.col("k")).cast("int"))
    # within blocks; in large tiles with the leaders in each block
    slot = F.pmod(F.xxhash64("set_key", F.lit(8)), F.lit(LEADERS))
    large = placed.where("k > 1")
    leaders = large.groupBy("hub", "band", slot.alias("slot")).agg(F.min(F.struct("set_key", "own", "block")).alias("l"), F.max("k").alias("k")).select("hub", "band", "k", "l.*")
    guests = leaders.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("k").cast("int") - 1))).where("to <> block").select("hub", "band", F.col("to").alias("block"), "set_key", "own")
    inside = placed.select("hub", "band", "block", "set_key", "own").unionByName(guests)
    inside = inside.select("hub", "band", F.col("block").alias("lo"), F.col("block").alias("hi"), "block", "set_key", "own", F.col("set_key").alias("known"))
    found = _linked(inside, kept)
    if blocks.where("k > 1").isEmpty():
        return found
    found = materialize(found, "jaccard-links")
    return found.unionByName(_linked(_apart(large, connected_components(found, "jaccard-near")), kept))


def _linked(spread: DataFrame, kept: DataFrame) -> DataFrame:
    """Links ``(a, b)`` among the members of each (tile, pair of blocks)."""
    full = spread.join(kept.select("set_key", "n", "tokens", "bitmap"), "set_key")
    # AQE splits the join's hot side; the grouping that follows holds one block, or pair of blocks, a row
    tiles = full.groupBy("hub", "band", "lo", "hi").agg(F.collect_list(F.struct(F.col("set_key").alias("rep"), "n", "own", "block", "known", "tokens", "bitmap")).alias("members"))
    return tiles.where("size(members) > 1").select("members").mapInArrow(_links, "a long, b long")


def _apart(large: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of blocks of the large tiles that are not one class yet.

    The members outside a tile's largest class are dealt to blocks of their own,
    which meet one another and each block of the largest class.
    """
    known = large.join(classes, F.col("set_key") == F.col("id"), "left").select("hub", "band", "set_key", "own", "k", F.coalesce("component", "set_key").alias("known"))
    known = materialize(known, "jaccard-known")
    sizes = known.groupBy("hub", "band", "known").agg(F.count("*").alias("n"))
    tiles = sizes.groupBy("hub", "band").agg(F.max(F.struct("n", "known")).alias("main"), F.sum("n").alias("m")).select("hub", "band", F.col("main.known").alias("main"), (F.col("m") - F.col("main.n")).alias("rest"), "m")
    tiles = tiles.where("rest > 0")
    both = known.join(tiles, ["hub", "band"])
    # blocks of the rest are numbered from 0, those of the largest class from -1 downwards
    rests = F.ceil(F.col("k") * F.col("rest") / F.col("m")).cast("int")
    mains = F.ceil(F.col("k") * (F.col("m") - F.col("rest")) / F.col("m")).cast("int")
    hashed = F.xxhash64("set_key", F.lit(9))
    is_main = F.col("known") == F.col("main")
    block = F.when(is_main, -1 - F.pmod(hashed, mains)).otherwise(F.pmod(hashed, rests)).cast("int")
    other = F.when(is_main, F.sequence(F.lit(0), rests - 1)).otherwise(F.sequence(-mains, rests - 1))
    # an own block meets itself too
    meets = both.withColumn("block", block).withColumn("other", F.explode(other))
    return meets.select("hub", "band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "set_key", "own", "known")


def _labelled(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, set_key, text_key, component, component_id)`` of every row; ``component`` names the class by a set's key."""
    of_sets = materialize(sets(docs), "jaccard-docs")
    found = connected_components(links(docs, of_sets), "jaccard-cc")
    least = of_sets.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"))
    named = least.join(found, F.col("set_key") == F.col("id"), "left").select("set_key", "least", F.coalesce("component", "set_key").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = named.join(ids, "component").select("set_key", "component", "component_id")
    out = of_sets.select("doc_id", "n_shingles", "set_key", "text_key").join(by_set, "set_key", "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id"))


def classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row for each row of ``docs(doc_id, text, ...)``.

    ``component_id`` is the least ``doc_id`` that links reach, the document
    included. Null, empty and wordless texts have size 0 and are alone. A row
    whose ``doc_id`` is null takes part like any other, names no class, and
    gets its class's least id (null when it is alone). Repeated rows are equal
    sets, hence one class. Other columns are ignored.
    """
    return _labelled(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one row of each class: that with the least ``doc_id``.

    Of rows that share this id the one whose text has the least hash stays, and
    of rows equal in both just one; a null id comes last. Another text under
    the id of a dropped row is judged by its own class. Texts without a word
    are in no class and stay.
    """
    named = materialize(_labelled(docs).where("set_key is not null").select("component", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key").alias("row")), "jaccard-named")
    stays = named.groupBy("component").agg(F.min("row").alias("stays"))
    judged = named.groupBy("component", "row").agg(F.count("*").alias("times")).join(stays, "component")
    id_is, text_is = F.col("doc_id").eqNullSafe(F.col("_jaccard_id")), F.col("_jaccard_text") == F.col("_jaccard_key")
    rows = docs.withColumn("_jaccard_text", text_key())
    key = [F.col("row.doc_id").alias("_jaccard_id"), F.col("row.text_key").alias("_jaccard_key")]
    # the rows that go have no size bound, so they are never broadcast
    out = rows.join(judged.where("row <> stays").select(*key).hint("merge"), id_is & text_is, "left_anti")
    twice = materialize(judged.where("row = stays and times > 1").select(*key), "jaccard-twice")
    if not twice.isEmpty():
        one = F.row_number().over(Window.partitionBy("doc_id", "_jaccard_text").orderBy("doc_id"))
        again = out.join(twice, id_is & text_is, "left_semi").withColumn("_jaccard_at", one).where("_jaccard_at = 1").drop("_jaccard_at")
        out = out.join(twice, id_is & text_is, "left_anti").unionByName(again)
    return out.select(docs.columns)


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document's set size and class; see ``classes`` for nulls, empty texts and repeats."""
    return classes(read(spark, sf_dir, "documents"))
