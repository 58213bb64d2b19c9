"""Operators 11 to 13 against brute force, and on awkward inputs."""

import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import filter_audit, packing, whitening

DATA = "/root/testdata/sf0.001"


# 11 -------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit(1)).withColumn("component", F.lit("x"))


def whole(rows):
    """Rows that count as whole numbers, filled to the longest."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, v in good), default=0)
    return [i for i, _ in good], np.array([[int(np.floor(64 * float(np.float32(c)))) for c in v] + [0] * (width - len(v)) for _, v in good], object)


def check(rows, out):
    ids, y = whole(rows)
    n, s = len(y), y.sum(0)
    t = n * y - s
    want = t.astype(float) / n
    values, q = np.linalg.eigh(want.T @ want / n)
    values, q = values[::-1], q[:, ::-1]
    by: dict = {}
    for r in out:
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    kept = len(next(iter(by.values())))
    assert kept == min(32, int((values > 1e-12 * values[0]).sum()))
    for k in range(kept):
        z = want @ q[:, k] / np.sqrt(values[k])
        mine = np.array([by[i][k + 1][0]["whitened"] for i in ids])
        assert np.abs(mine * np.sign(mine @ z) - z).max() < 1e-9
    for i, d in zip(ids, (t * t).sum(1), strict=True):
        r = by[i][1][0]
        assert r["n"] == n and r["deviation"] == int(d)
        assert r["explained"] == pytest.approx(values[0] / values.sum()) and r["identity_error"] < 1e-9


def run11(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    return whitening.op11_whitening(spark, str(tmp_path))


def test_whitening_equals_eigenvectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 40)) * np.linspace(3, 0.2, 40) @ rng.standard_normal((40, 40)) + 5)]
    rows += [(1000, None), (1001, [None] * 40), (1002, [float("nan")] * 40), (1003, [float("inf"), *[0.0] * 39])]
    out = run11(spark, vectors(spark, rows), tmp_path).collect()
    assert len(out) == 300 * 32
    check(rows, out)


def test_whitening_stops_early_in_wide_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 3)) * [9, 5, 2] @ rng.standard_normal((3, 200)) + 0.01 * rng.standard_normal((400, 200))
    calls = []
    x = x - x.mean(0)

    def multiply(c):
        calls.append(1)
        u = x @ c
        return x.T @ u, float(u @ u)

    found = whitening.bidiagonalise(multiply, 200, 3)[:, :3]
    want = np.linalg.svd(x, full_matrices=False)[2][:3].T
    assert np.abs(np.abs((found * want).sum(0)) - 1).max() < 1e-12 and len(calls) < 60


def test_whitening_of_repeated_and_missing_directions(spark, tmp_path):
    """Equal variances, dimensions without any, repeated rows, null ids and short vectors."""
    rows = [(10 * k + 2 * j + s, [float((1 - 2 * s) * (j == d)) if d < 3 else 7.0 for d in range(5)]) for k in range(4) for j in range(3) for s in (0, 1)]
    out = run11(spark, vectors(spark, rows), tmp_path).collect()
    assert len(out) == len(rows) * 3 and max(r["identity_error"] for r in out) < 1e-9
    assert all(r["explained"] == pytest.approx(1 / 3) for r in out)
    again = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [4.0]), (4, [0.5, 0.25, 1.0]), (5, [])]
    got = whitening.whiten(vectors(spark, again), "embedding", ["vec_id"]).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["3", "4", "5", "None", "None"] and len(got[0]["whitened"]) == 3


def test_whitening_without_spread_or_rows(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])]):
        assert whitening.whiten(vectors(spark, rows), "embedding", ["vec_id"]).collect() == []


def test_deviations_stay_exact_when_large():
    y = np.array([[1 << 33, -(1 << 33)], [5, 7], [0, 1]])
    centre = whitening.Centre(3, [int(v) for v in y.sum(0)])
    want = [sum((3 * int(a) - int(s)) ** 2 for a, s in zip(row, y.sum(0), strict=True)) for row in y]
    assert [int(v) for v in centre.deviations(y).to_pylist()] == want and max(want) > 1 << 63


# 12 -------------------------------------------------------------------------


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.public_vocabulary())


def test_encoder_equals_the_tokenizer(monkeypatch):
    rng = random.Random(12)
    signs = ["'s", "don't", "I'LL", "'", "''s", "<|endoftext|>", "<|x", "naïve", "ÉTÉ", "ß", "é", "İ", "ΣΑΣ", "½", "x²y", "12,5", " a ", "a\u0085b", "\x1c", "日本語", "💩x", "ſ", "µ", "ª1", "http://x.y/?a=b&c", "ﬁn", "", "한국", "​z", "a b"]
    texts = ["".join(map(chr, range(256))), *map(chr, range(256)), *(f"a{chr(i)}B" for i in range(256))]
    texts += [None, "", " \t\n\x0b\x0c\r", "x" * 5000] + ["".join(rng.choice(signs) + rng.choice([" ", "", "\n", "  "]) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    encode = packing.Encoder(packing.public_vocabulary())
    want = [e.ids for e in tokenizer().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [np.frombuffer(x, "<u2").tolist() for x in encode(texts)] == want
    monkeypatch.setattr(packing, "CACHE", 40)  # kept words are thrown away again and again
    assert [np.frombuffer(x, "<u2").tolist() for x in packing.Encoder(packing.public_vocabulary())(texts)] == want


def check12(out, docs, window):
    """Every id once, at its place, in sequences without gaps that are full or a power of two."""
    ids = {i: np.array([*e.ids, 1], "<u4") for (i, _), e in zip(docs, tokenizer().encode_batch([t or "" for _, t in docs], add_special_tokens=False), strict=True)}
    pieces, sequences = {}, {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for i, some in pieces.items():
        at = 0
        for r in sorted(some, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[i])
            assert r["ids_crc32"] == zlib.crc32(ids[i][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[i])
    short = []
    for some in sequences.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        if at != window:
            short.append(at)
    assert all(n & (n - 1) == 0 and n < window for n in short) and sum(short) < window
    assert sorted(sequences) == list(range(len(sequences)))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("rest", F.lit(1)).withColumn("ids", F.lit("x"))


@pytest.mark.parametrize("window", [16, 64, 2048])
def test_packing_keeps_every_token(spark, window):
    rng = random.Random(window)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 3, window // 2, window - 1, window, rng.randint(1, 3 * window)])))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (1002, "a " * (5 * window))] + [(2000 + i, "b " * (window // 4 - 1)) for i in range(100)]
    out = packing.with_checksums(packing.pack(documents(spark, rows).repartition(5), window=window)).collect()
    check12(out, rows, window)


def test_packing_awkward(spark):
    rows = [(None, "a b"), (None, "a b"), (3, "x"), (3, "another"), (4, None)]
    out = packing.pack(documents(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in out if r["start"] == 0) == ["3", "3", "4", "None", "None"]
    assert packing.pack(documents(spark, [])).count() == 0


def test_plan_leaves_documents_whole():
    """Combinations fill windows exactly, use no length beyond its rows, and keep most remainders in one piece."""
    rng = np.random.default_rng(5)
    histogram = np.bincount(np.minimum(127, rng.geometric(0.03, 20_000)), minlength=128)
    histogram[0] = 50
    p = packing.plan(histogram, 128)
    assert (p.used <= histogram).all() and p.used[0] == 0 and p.sequences > 0
    placed = {}
    cut = 0
    for n in range(128):
        for number in range(int(histogram[n])):
            some = packing.pieces(p, n, number)
            assert sum(x[2] for x in some) == n
            cut += len(some) > 1
            for sequence, offset, size in some:
                placed.setdefault(sequence, []).append((offset, size))
    lengths = []
    for some in placed.values():
        at = 0
        for offset, size in sorted(some):
            assert offset == at
            at += size
        lengths.append(at)
    assert sum(1 for x in lengths if x != 128) <= 7
    assert cut < 0.1 * histogram.sum()


def test_least_squares_is_non_negative_and_optimal():
    rng = np.random.default_rng(6)
    histogram = rng.integers(0, 60, 32)
    columns = packing.combinations(np.flatnonzero(histogram), 32)
    assert all(sum(c) == 32 for c in columns) and len(columns) == len({tuple(c) for c in columns.tolist()})
    want = {tuple(sorted(c)) for k in (2, 3) for c in itertools.combinations_with_replacement([n for n in range(1, 32) if histogram[n]], k) if sum(c) == 32}
    assert {tuple(x for x in c if x) for c in columns.tolist()} == want
    x = packing.least_squares(columns, histogram)
    a = np.zeros((32, len(columns)))
    for j, c in enumerate(columns):
        for n in c:
            if n:
                a[n, j] += 1
    h = histogram.astype(float)
    h[0] = 0
    slope = a.T @ (a @ x - h)
    assert (x >= 0).all() and slope.min() > -0.05 * h.max() and abs(slope @ x) < 0.02 * (h @ h)


# 13 -------------------------------------------------------------------------


def brute_audit(rows, labels):
    mark = lambda i, c: any(r[c] == 1 for r in labels if r[0] is not None and r[0] == i)
    fails = []
    for i, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        e = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails.append((lang or "", {f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), e), strict=True) if x}, mark(i, 1), mark(i, 2)))
    out = {}
    for part in {p for p, *_ in fails}:
        mine = [x for x in fails if x[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                here = [x for x in mine if f in x[1] and not x[1] & set(order[:k])]
                total[f] += len(here)
                kept = sum(not x[1] & set(order[: k + 1]) for x in mine)
                failing = sum(f in x[1] for x in mine)
                out[part, "".join(order), k + 1] = (kept, len(here), failing - len(here), sum(x[1] == {f} for x in mine), sum(x[2] for x in here), sum(x[3] for x in here))
        for (p, order, k), v in list(out.items()):
            if p == part:
                out[p, order, k] = (*v[:6], total[order[k - 1]])
    return out


def test_audit_equals_brute_force(spark):
    rng = random.Random(13)
    base = [" ".join(rng.choice(["a", "B", "cd", "E#", "fgh", f"w{rng.randrange(400)}"]) for _ in range(rng.choice([0, 5, 199, 200, 260]))) for _ in range(25)]
    texts = [*base, None, "", " \n\x0b ", "ÀÉ é", "A" * 3 + "é" * 97, "x " * 200, "word " * 150_000]
    rows = [(rng.choice([None, *range(40)]) if rng.random() < 0.4 else i, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for i in range(120)]
    rows += rows[:10]
    labels = [(rng.choice([None, *range(120)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("n", "part", "mask", "digest", "quality", "toxic")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("salt", F.lit(3))
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in filter_audit.audit(docs, marks).collect()}
    assert got == brute_audit(rows, labels)


def test_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a", "en")], docs.schema)
    out = filter_audit.audit(one, labels).collect()
    assert len(out) == 600 and {r["shapley"] for r in out if r["filter_order"][r["step"] - 1] == "A"} == {120}


@pytest.mark.parametrize("seed", range(3))
def test_shapley_by_constrained_least_squares(seed):
    """The rational solution is the mean marginal value over all orders."""
    rng = random.Random(seed)
    game = [rng.randint(0, 1000) for _ in range(32)]
    want = [Fraction(0)] * 5
    for order in itertools.permutations(range(5)):
        s = 0
        for i in order:
            want[i] += Fraction(game[s | 1 << i] - game[s], 120)
            s |= 1 << i
    assert filter_audit.shapley(game) == want
