"""Operator 12: packing by non-negative least squares over length combinations.

A text's tokens and its closing id first fill whole windows; the rest, shorter
than a window, is its remainder. Combinations of two or three remainder lengths
that fill a window exactly are the columns of a matrix; non-negative least
squares against the histogram of remainders gives how often each repeats.
Repeats are rounded without using more remainders than there are. What is left
is packed greedily, length by length, each window filled to the brim and the
remainder at its end cut; the tokens of the last window go into sequences whose
lengths are powers of two, which need no padding.

Scale: texts are tokenized once, and their ids written to the shared folder as
two bytes each. The task that tokenizes also counts the rows of each remainder
length it has seen, so a row's number within its length is that count plus the
counts of the tasks before: no sort, and no group of equal rows or lengths is
ever in one task. Only the histogram, one number a length, is on the driver; a
row's place follows from its number by arithmetic or a binary search in the
plan, which is bounded by the number of combinations.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from panelforge.llm.common import materialize, read

WINDOW = 2048
CLOSING = 1
VOCABULARY = "word_bpe_49k.json"
#: Parts kept by a task, rounds of least squares, and the relative error at which they end.
CACHE, ROUNDS, CLOSE = 500_000, 400, 1e-4
#: Letters and digits of Latin-1, and its white space.
LETTERS, DIGITS, BLANK = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
#: The tokenizer's own pattern on lower-cased Latin-1.
PARTS = rf"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{DIGITS}]|[^{BLANK}{LETTERS}{DIGITS}]+"


class _Kept(dict):
    """Bytes of the ids of what was asked for before; all are forgotten when there are too many."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        out = self[key] = self.encode(key)
        return out


class Encoder:
    """Token ids of texts by a public word tokenizer, as little-endian two-byte strings.

    The tokenizer drops white space and never joins characters across it, so a
    text's ids are those of its words one after the other. In Latin-1, where
    lower case and normal forms act by character, its pattern cuts the text
    into parts; each goes once to the tokenizer's model, in its byte alphabet.
    Words with other characters, or with the beginning of a special token, are
    given to the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids don't fit in two bytes")
        self.model, self.parts_of = self.tokenizer.model, re.compile(PARTS).findall
        # the model's character for each byte; bytes of a longer character can't be asked for alone
        alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
        plain = [c for c in alphabet if ord(c) < 256]
        rest = iter(c for c in alphabet if ord(c) >= 256)  # the others in the order of their bytes
        self.alphabet = {b: chr(b) if chr(b) in plain else next(rest) for b in range(256)}
        self.parts, self.words = _Kept(self._part), _Kept(self._word)

    def _part(self, part: str) -> bytes:
        tokens = self.model.tokenize(part.encode("utf-8").decode("latin-1").translate(self.alphabet))
        return struct.pack(f"<{len(tokens)}H", *[t.id for t in tokens])

    def _word(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}H", *ids)

    def _latin(self, text: str) -> bytes | None:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if "<|" in text else b"".join(map(self.parts.__getitem__, self.parts_of(text.lower())))

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text, null as empty."""
        for text in texts:
            out = self._latin(text or "")
            if out is None:
                words = (w.decode("utf-8") for w in text.encode("utf-8").split())  # white space of ASCII only
                out = b"".join(self.words[w] if (ids := self._latin(w)) is None else ids for w in words)
            yield out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker, whatever the number of its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def tokenized(docs: DataFrame, key: str, path: str | None, window: int) -> DataFrame:
    """``(key, ids, total, rest, part, rank, full)``, written: bytes of the ids with the closing one, their number, the remainder.

    ``rank`` numbers the rows of a remainder within their part, ``full`` is the
    number of whole windows before the row within its part.
    """
    closing = np.array([CLOSING], "<u2").tobytes()

    def run(batches):
        encode, part = encoder(path or public_vocabulary()), TaskContext.get().partitionId()
        seen, windows = np.zeros(window, np.int64), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                ids = [x + closing for x in encode(some.column(1).to_pylist())]
                total = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
                rest, rank, full = total % window, [], []
                for r, q in zip(rest.tolist(), (total // window).tolist(), strict=True):
                    rank.append(int(seen[r]))
                    full.append(windows)
                    seen[r] += 1
                    windows += q
                columns = [pa.array(ids, pa.binary()), pa.array(total), pa.array(rest), pa.array(np.full(len(ids), part)), pa.array(rank, pa.int64()), pa.array(full, pa.int64())]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], [key, "ids", "total", "rest", "part", "rank", "full"])

    kind = dict(docs.dtypes)[key]
    return materialize(docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, ids binary, total long, rest long, part long, rank long, full long"), "packing-ids")


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, b, c), a <= b <= c, of lengths that fill a window; a is 0 where two do."""
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    ordered = np.unique(lengths[lengths > 0])
    found = []
    for a in [0, *ordered.tolist()]:
        b = ordered[(ordered >= a) & (2 * ordered <= window - a)]
        b = b[present[window - a - b]]
        found.append(np.column_stack([np.full(len(b), a), b, window - a - b]))
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def least_squares(columns: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative repeats x of the columns that bring their lengths' sum nearest the histogram.

    Accelerated projected gradient, started anew when it overshoots; the matrix
    is never built: a column is its two or three lengths.
    """
    h = histogram.astype(float)
    h[0] = 0

    def made(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(columns[:, k], x, len(h)) for k in range(3))
        out[0] = 0
        return out

    def slopes(r: np.ndarray) -> np.ndarray:
        return r[columns[:, 0]] + r[columns[:, 1]] + r[columns[:, 2]]

    x = np.zeros(len(columns))
    if not len(columns) or not h.any():
        return x
    steepness = float(slopes(made(np.ones(len(columns)))).max())  # bounds the largest eigenvalue: the largest row sum of A'A
    y, t, last = x, 1.0, np.inf
    for _ in range(ROUNDS):
        r = made(y) - h
        then = np.maximum(0.0, y - slopes(r) / steepness)
        error = float(r @ r)
        if error > last:
            y, t, last = x, 1.0, np.inf
            continue
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        moved = float(np.abs(then - x).sum())
        y, x, t, last = then + (t - 1) / s * (then - x), then, s, error
        if moved <= CLOSE * max(1e-9, float(x.sum())):
            break
    return x


class Plan(NamedTuple):
    """Where the remainders go. The rows of length l with numbers from ``start`` of an entry on fill its combination's slots."""

    window: int
    key: np.ndarray  #: length * span + first number of an entry, ascending
    first: np.ndarray  #: first sequence of the entry
    slots: np.ndarray  #: rows of this length in each of its sequences
    place: np.ndarray  #: offset of the first such row
    used: np.ndarray  #: rows of each length that combinations take
    base: np.ndarray  #: token at which a length's left rows begin in the stream of left remainders
    span: int
    sequences: int  #: sequences that combinations fill
    left: int  #: tokens of left remainders


def plan(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """Repeats by least squares, rounded so that no length is used beyond its rows."""
    columns = combinations(np.flatnonzero(histogram), window) if histogram.any() else np.empty((0, 3), np.int64)
    x = least_squares(columns, histogram)
    have, keys, firsts, slots, places, at = histogram.astype(np.int64).copy(), [], [], [], [], 0
    have[0] = 0
    used = np.zeros(window, np.int64)
    span = int(histogram.max(initial=0)) + 1
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 0.5:
            break
        lengths, need = np.unique(columns[i][columns[i] > 0], return_counts=True)
        times = min(int(x[i] + 0.5), *[int(have[n]) // int(k) for n, k in zip(lengths, need, strict=True)])
        if times <= 0:
            continue
        place = 0
        for n, k in zip(lengths.tolist(), need.tolist(), strict=True):
            keys.append(n * span + int(used[n]))
            firsts.append(at)
            slots.append(k)
            places.append(place)
            used[n] += k * times
            have[n] -= k * times
            place += n * k
        at += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    tokens = have * np.arange(window)
    pick = lambda values: np.array(values, np.int64)[order]
    return Plan(window, pick(keys), pick(firsts), pick(slots), pick(places), used, np.cumsum(tokens) - tokens, span, at, int(tokens.sum()))


def powers(left: int, window: int) -> list[tuple[int, int]]:
    """(first token, length) of the sequences of the stream's last, partial window: powers of two, largest first."""
    at, rest, out = left - left % window, left % window, []
    while rest:
        size = 1 << (rest.bit_length() - 1)
        out.append((at, size))
        at, rest = at + size, rest - size
    return out


def pieces(p: Plan, rest: int, number: int) -> list[tuple[int, int, int]]:
    """(sequence, offset, length) of the pieces of the remainder ``rest`` with this number, in order."""
    if not rest:
        return []
    if number < p.used[rest]:
        i = int(np.searchsorted(p.key, rest * p.span + number, "right")) - 1
        within = rest * p.span + number - int(p.key[i])
        times, slot = divmod(within, int(p.slots[i]))
        return [(int(p.first[i]) + times, int(p.place[i]) + slot * rest, rest)]
    at = int(p.base[rest]) + (number - int(p.used[rest])) * rest
    end, out = at + rest, []
    tail = p.left - p.left % p.window
    while at < end:
        if at < tail:
            size = min(end, at - at % p.window + p.window) - at
            out.append((p.sequences + at // p.window, at % p.window, size))
        else:
            k, (first, length) = next((k, x) for k, x in enumerate(powers(p.left, p.window)) if at < sum(x))
            size = min(end, first + length) - at
            out.append((p.sequences + tail // p.window + k, at - first, size))
        at += size
    return out


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, key: str = "doc_id", path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Each piece of each text: ``(key, start, length, ids, doc_tokens, sequence_id, offset)``; ``ids`` are two-byte ids.

    Null texts count as empty and hold the closing id alone. Repeated rows and
    rows with null keys are packed each. An empty table gives no row. Other
    columns are ignored. All sequences are full but those of the last window,
    whose lengths are powers of two.
    """
    spark = docs.sparkSession
    rows = tokenized(docs, key, path, window)
    # a row for each part and length that occur, at most ``window`` a part
    seen = rows.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("total") / window)).alias("windows"))
    seen = materialize(seen, "packing-counts")
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = seen.select("part", "rest", earlier.alias("earlier"))
    by_part = seen.groupBy("part").agg(F.sum("windows").alias("windows"))  # a row a part
    before = by_part.select("part", F.coalesce(F.sum("windows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    tables = starts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("rest", "earlier"))).alias("earlier")).join(before, "part")
    histogram = np.zeros(window, np.int64)
    for r in seen.groupBy("rest").agg(F.sum("n").alias("n")).collect():  # a number for each length
        histogram[r["rest"]] = r["n"]
    p = plan(histogram, window)
    shared = spark.sparkContext.broadcast(p)
    base = p.sequences + p.left // window + len(powers(p.left, window))
    placed = rows.join(tables, "part").select(key, "ids", "total", "rest", (F.col("rank") + F.coalesce(F.col("earlier")[F.col("rest")], F.lit(0))).alias("number"), (F.col("full") + F.col("before") + base).alias("full"))

    def run(batches):
        p = shared.value
        for batch in batches:
            of, out = [], []
            for i, (ids, total, rest, number, full) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(1, 6)], strict=True)):
                whole = [(full + k, 0, window) for k in range(total // window)]
                at = 0
                for sequence, offset, size in whole + pieces(p, rest, number):
                    of.append(i)
                    out.append((at, size, ids[2 * at : 2 * (at + size)], total, sequence, offset))
                    at += size
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array([r[c] for r in out], kinds[c]) for c in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *columns], [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = dict(docs.dtypes)[key]
    return placed.mapInArrow(run, f"`{key}` {kind}, " + SCHEMA.replace("ids_crc32 long", "ids binary"))


def with_checksums(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """CRC-32 of each piece's ids as little-endian unsigned 32-bit numbers in place of the ids."""

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index("ids")
            sums = [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in batch.column(i).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64()) if c == i else batch.column(c) for c in range(batch.num_columns)], [("ids_crc32" if c == i else name) for c, name in enumerate(batch.schema.names)])

    kind = dict(packed.dtypes)[key]
    return packed.mapInArrow(run, f"`{key}` {kind}, " + SCHEMA)


def op12_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place and the CRC-32 of its ids."""
    return with_checksums(pack(read(spark, sf_dir, "documents").select("doc_id", "text")))
