"""Operator 10: language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. A
word's probability is the sum over all its segmentations into pieces, by a
forward pass; a text's is the product over its words.

Learning runs expectation maximisation over all segmentations (forward and
backward passes on distinct words and their counts) on a sample of at most
``SAMPLE`` labelled documents. The model has at most one row for each piece and
language and is sent to all tasks. Scoring is one narrow scan of whole texts:
no shuffle, memory bounded by the word cache.
"""

from __future__ import annotations

import copy
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelforge.llm.common import mix64, read

#: Vocabulary file, labelled documents to learn from in all and of a language at least, EM rounds, languages in a table at a time, words kept in a task's cache.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE = 4_000
LEAST = 4
ROUNDS = 2
LANGUAGES = 200
CACHE = 200_000
#: Share of the pooled distribution in each language's, and the probability of a character outside the vocabulary.
POOLED = 0.02
UNSEEN = 1e-9
START = "▁"
UNDETERMINED = "und"


def pieces(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces, lower-cased, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(out)


def by_length(words: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, code points as a matrix) of the words of one length at a time, each with ``START`` before it."""
    words = list(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        for lo in range(0, len(at), 20_000):
            some = at[lo : lo + 20_000]
            raw = "".join(START + words[i] for i in some).encode("utf-32-le", "surrogatepass")
            yield some, np.frombuffer(raw, "<u4").reshape(len(some), n + 1).astype(np.uint64)


class Unigrams:
    """Piece probabilities of several languages (rows: pieces, columns: languages); sums over segmentations.

    Words of one length are handled together: substrings are looked up by their
    polynomial hash, first in a bit table, then in the sorted piece hashes.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, names: list[str], table: np.ndarray):
        self.names, self.width = names, table.shape[1]
        self.longest = max(map(len, names), default=1)
        keys = np.array([self._hash(p) for p in names], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(mix64(self.keys) >> np.uint64(44)).astype(np.int64)] = True
        self.table = np.vstack([table, np.full((1, self.width), UNSEEN)])  # the last row: an unknown character

    def holding(self, table: np.ndarray) -> Unigrams:
        """The same pieces with another table."""
        out = copy.copy(self)
        out.width, out.table = table.shape[1], np.vstack([table, np.full((1, table.shape[1]), UNSEEN)])
        return out

    def _hash(self, piece: str) -> int:
        out = 0
        for c in piece:
            out = (out * int(self.BASE) + ord(c) + 1) % (1 << 64)
        return out

    def prefixes(self, codes: np.ndarray) -> list[np.ndarray]:
        out = [np.zeros(len(codes), np.uint64)]
        with np.errstate(over="ignore"):
            for j in range(codes.shape[1]):
                out.append(out[-1] * self.BASE + codes[:, j] + np.uint64(1))
        return out

    def edges(self, prefix: list[np.ndarray], j: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(start, words, pieces) of the pieces that end at j; a lone unknown character counts as one."""
        with np.errstate(over="ignore"):
            power = np.uint64(1)
            for i in range(j - 1, max(0, j - self.longest) - 1, -1):
                power = power * self.BASE
                key = prefix[j] - prefix[i] * power
                at = np.flatnonzero(self.bits[(mix64(key) >> np.uint64(44)).astype(np.int64)])
                place = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
                hit = self.keys[place] == key[at]
                at, ids = at[hit], self.ids[place[hit]]
                if i == j - 1 and len(at) < len(key):
                    lone = np.full(len(key), len(self.table) - 1)
                    lone[at] = ids
                    at, ids = np.arange(len(key)), lone
                if len(at):
                    yield i, at, ids

    def log_probability(self, words: list[str]) -> np.ndarray:
        """Log of each word's probability in each language, summed over all segmentations."""
        out = np.empty((len(words), self.width))
        for some, codes in by_length(words):
            prefix = self.prefixes(codes)
            alpha, logs = [np.ones((len(some), self.width))], np.zeros((len(some), self.width))
            for j in range(1, codes.shape[1] + 1):
                now = np.zeros((len(some), self.width))
                for i, at, ids in self.edges(prefix, j):
                    now[at] += alpha[i][at] * self.table[ids]
                alpha.append(now)
                if j > self.longest:
                    alpha[j - self.longest - 1] = None
                if now.min() < 1e-150:  # keep long words above underflow
                    scale = np.where(now < 1e-150, 1 / now, 1.0)
                    logs -= np.log(scale)
                    for i in range(max(0, j - self.longest), j + 1):
                        alpha[i] = alpha[i] * scale
            out[some] = np.log(alpha[-1]) + logs
        return out

    @staticmethod
    def _sums(edges: list[list], places: Iterable[int], p: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all ways to each place, as value * exp(log), so that long words don't underflow."""
        value, log, last = np.zeros((len(edges), rows)), np.zeros((len(edges), rows)), None
        for here in places:
            if last is None:
                value[here] = 1.0
            else:
                log[here] = log[last]
                for there, at, ids in edges[here]:
                    value[here, at] += value[there, at] * p[ids] * np.exp(log[there, at] - log[here, at])
                low = (value[here] > 0) & (value[here] < 1e-100)
                log[here, low] += np.log(value[here, low])
                value[here, low] = 1.0
            last = here
        return value, log

    def expected(self, words: list[str], counts: np.ndarray, lang: int) -> np.ndarray:
        """Expected uses of each piece in counted words of one language, over all segmentations."""
        out = np.zeros(len(self.table))
        for some, codes in by_length(words):
            prefix, size, p, rows = self.prefixes(codes), codes.shape[1], self.table[:, lang], len(some)
            into = [[], *([(i, at, ids) for i, at, ids in self.edges(prefix, j)] for j in range(1, size + 1))]
            out_of: list[list] = [[] for _ in range(size + 1)]
            for j, edges in enumerate(into):
                for i, at, ids in edges:
                    out_of[i].append((j, at, ids))
            alpha, before = self._sums(into, range(size + 1), p, rows)
            beta, after = self._sums(out_of, range(size, -1, -1), p, rows)
            for j, edges in enumerate(into):
                for i, at, ids in edges:
                    share = np.exp(before[i, at] + after[j, at] - before[size, at])
                    np.add.at(out, ids, counts[some][at] * alpha[i, at] * p[ids] * beta[j, at] * share / alpha[size, at])
        return out[:-1]


class Languages:
    """Piece probabilities of any number of languages: a common part and what each language's sample adds.

    What is added is bounded by the sample, whatever the number of languages;
    full tables are made for ``LANGUAGES`` of them at a time.
    """

    def __init__(self, pieces: Unigrams, size: int, common: np.ndarray, of: np.ndarray, piece: np.ndarray, p: np.ndarray):
        order = np.argsort(of, kind="stable")
        self.pieces, self.size, self.common, self.of, self.piece, self.p = pieces, size, common, of[order], piece[order], p[order]
        self.whole = self._block(0) if size <= LANGUAGES else None

    def _block(self, lo: int) -> Unigrams:
        width = min(LANGUAGES, self.size - lo)
        table = np.repeat(self.common[:, None], width, 1)
        a, b = np.searchsorted(self.of, [lo, lo + width])
        table[self.piece[a:b], self.of[a:b] - lo] += self.p[a:b]
        return self.pieces.holding(table)

    def blocks(self) -> Iterator[tuple[int, Unigrams]]:
        """(first language, their unigrams), a block at a time."""
        for lo in range(0, self.size, LANGUAGES):
            yield lo, self.whole or self._block(lo)


def _count(model: Languages, langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {lang: k for k, lang in enumerate(langs)}
        for batch in batches:
            of, words, n = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64), batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for lo, unigrams in model.blocks():
                for k in np.unique(of[(of >= lo) & (of < lo + unigrams.width)]):
                    mine = np.flatnonzero(of == k)
                    sums = unigrams.expected([words[i] for i in mine], n[mine], k - lo)
                    used = np.flatnonzero(sums)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k)), pa.array(used.astype(np.int64)), pa.array(sums[used])], ["lang", "piece", "n"])

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted words of each language, by the same words as in prediction."""
    for batch in batches:
        found: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found.update((lang, w) for w in words_of(text) or ())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(map(float, found.values())), pa.float64())], ["lang", "word", "n"])


def learn(labelled: DataFrame, path: str = VOCABULARY, sample: int = SAMPLE) -> tuple[list[str], Languages]:
    """Languages in order and their unigrams, from ``labelled(doc_id, text, lang)``.

    Rows with a null text or language are left out. Each of L languages is
    learned from ``sample`` / L of its rows, ``LEAST`` where that is less, those
    lowest in the range of a hash, so a rare one is learned on large tables as
    well; a language of fewer rows from all of them. Equal rows are used or
    left out together.
    """
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    of = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    langs, most = sorted(of), 1_000_000_000_000
    each = max(LEAST, sample / max(1, len(of)))
    shares = rows.sparkSession.createDataFrame([(lang, math.ceil(most * min(1.0, each / of[lang]))) for lang in langs], "lang string, share long")
    chosen = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", "text", F.lit(10)), F.lit(most)) < F.col("share"))
    words = chosen.select("lang", "text").mapInArrow(_words, "lang string, word string, n double").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    vocabulary = pieces(path)
    size, none = len(vocabulary), np.empty(0, np.int64)
    index = Unigrams(vocabulary, np.empty((size, 0)))
    model = Languages(index, len(langs), np.full(size, 1 / size), none, none, np.empty(0))
    for _ in range(ROUNDS if langs else 0):
        # at most a number for each language and piece of the sample
        found = words.mapInArrow(_count(model, langs), "lang long, piece long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).orderBy("lang", "piece").collect()
        lang, piece, n = (np.array([r[c] for r in found], kind) for c, kind in (("lang", np.int64), ("piece", np.int64), ("n", float)))
        totals = np.maximum(1.0, np.bincount(lang, n, len(langs)))
        pooled = (np.bincount(piece, n, size) + 0.5 / size) / (n.sum() + 0.5)
        model = Languages(index, len(langs), POOLED * pooled, lang, piece, (1 - POOLED) * n / totals[lang])
    words.unpersist()
    return langs, model


def words_of(text: str | None) -> list[str] | None:
    """Lower-cased words between Unicode white space; none for a text that is null or has no letter."""
    return text.lower().split() if text and any(map(str.isalpha, text)) else None


class _Known:
    """Log probabilities of words in one block of languages; those of known words are kept."""

    def __init__(self, model: Unigrams):
        self.model, self.at, self.matrix = model, {}, np.empty((4096, model.width))

    def rows(self, words: set[str]) -> tuple[dict[str, int], np.ndarray]:
        if len(self.at) > CACHE:
            self.at = {}
        fresh = [w for w in words if w not in self.at]
        if fresh:
            have = len(self.at)
            if have + len(fresh) > len(self.matrix):  # twice the room each time
                room = np.empty((2 * (have + len(fresh)), self.model.width))
                room[:have] = self.matrix[:have]
                self.matrix = room
            self.matrix[have : have + len(fresh)] = self.model.log_probability(fresh)
            self.at.update(zip(fresh, range(have, have + len(fresh)), strict=True))
        return self.at, self.matrix


def _said(langs: list[str], model: Languages):
    """For each batch in turn its predictions and scores; where one block holds all languages, known words are kept from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], list[float]]]:
        kept = _Known(model.whole) if langs and model.whole else None
        for batch in batches:
            preds, scores = [], []
            for lo in range(0, batch.num_rows, 512):
                parts = [words_of(t) if langs else None for t in batch.column("text").slice(lo, 512).to_pylist()]
                words = {w for some in parts if some for w in some}
                best, top, total = np.zeros(len(parts), np.int64), np.full(len(parts), -np.inf), np.full(len(parts), -np.inf)
                for first, unigrams in model.blocks() if words else ():
                    at, matrix = (kept or _Known(unigrams)).rows(words)
                    for i, some in enumerate(parts):
                        if some is not None:
                            x = matrix[np.fromiter(map(at.__getitem__, some), np.int64, len(some))].sum(0)
                            k = int(x.argmax())
                            total[i] = np.logaddexp(total[i], x[k] + np.log(np.exp(x - x[k]).sum()))
                            if x[k] > top[i]:
                                best[i], top[i] = first + k, x[k]
                preds += [UNDETERMINED if some is None else langs[k] for some, k in zip(parts, best, strict=True)]
                scores += [0.0 if some is None else min(1.0, float(np.exp(t - s))) for some, t, s in zip(parts, top, total, strict=True)]
            yield batch, preds, scores

    return run


def _predict(langs: list[str], model: Languages):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, preds, scores in _said(langs, model)(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, langs: list[str], model: Languages) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row, from its whole text.

    ``lang_pred`` is ``und`` with score 0 for texts that are null, empty or
    without a letter, and where no language was learned. Equal probabilities
    go to the language first in the alphabet. Other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(_predict(langs, model), "doc_id long, lang_pred string, score double")


def _judge(langs: list[str], model: Languages, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, preds, scores in _said(langs, model)(batches):
            yield batch.filter(pa.array([p != UNDETERMINED and s >= least for p, s in zip(preds, scores, strict=True)], pa.bool_()))

    return run


def keep_identified(docs: DataFrame, langs: list[str], model: Languages, least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, whose language is found with at least this score."""
    if not langs:  # nothing to judge by
        return docs
    return docs.mapInArrow(_judge(langs, model, least), docs.schema)


def held_out(docs: DataFrame):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """A language for every document; texts that are null or have no letter are ``und``, a null id is in the fold of the empty text, repeated rows get a row each."""
    docs = read(spark, sf_dir, "documents")
    langs, model = learn(docs.select("doc_id", "text", "lang").where(~held_out(docs)))
    out = predict(docs, langs, model)
    return out.select("doc_id", held_out(out).alias("held_out"), "lang_pred", "score")
