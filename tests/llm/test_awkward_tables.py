"""Registered queries on empty tables and beside columns of other tables' names; the decision list against a plain cover."""

import base64
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F
from test_llm_operators import AWKWARD, clashing, pages_of, prose, table

from panelforge.llm import personal_data, quality_rules, toxicity, warc

LABELS = "doc_id long, quality int, toxic int"


def written(spark, folder, texts, labels=()):
    """A folder of tables whose documents also have the labels' names, and names that operators use inside."""
    docs = clashing(table(spark, texts)).withColumns({c: F.lit(1) for c in ("quality", "toxic", "kept", "held_out", "predicted", "spans", "_w", "_quality")})
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), LABELS).withColumns({"text": F.lit("label"), "score": F.lit(0.5)}).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("query", [toxicity.op2_toxicity, personal_data.op6_personal_data, quality_rules.op8_quality_rules])
def test_empty_tables(spark, tmp_path, query):
    assert query(spark, written(spark, tmp_path, [])).collect() == []


def test_toxicity_beside_clashing_columns(spark, tmp_path):
    """A column ``toxic`` of the documents is no label: with it, results are those without it."""
    rng = random.Random(5)
    texts = [prose(rng, 15) + (" vile rotten scum" if i % 3 == 0 else " kind calm friend") for i in range(120)] + AWKWARD
    labels = [(i, 1, int(i % 3 == 0)) for i in range(120)]
    out = toxicity.op2_toxicity(spark, written(spark, tmp_path, texts, labels)).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(len(texts)))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    clean = [r for r in out if r["doc_id"] < 120 and r["held_out"]]
    assert all(r["predicted"] == (r["doc_id"] % 3 == 0) for r in clean)
    at, w = toxicity.learn(table(spark, texts), spark.createDataFrame(labels, LABELS))
    again, w2 = toxicity.learn(clashing(table(spark, texts)).withColumn("toxic", F.lit(1)), spark.createDataFrame(labels, LABELS))
    assert at.tolist() == again.tolist() and w.tolist() == w2.tolist()


def test_personal_data_and_quality_beside_clashing_columns(spark, tmp_path):
    texts = [*AWKWARD, "mail a@b.com or +49 30 1234567", "1.2.3.4 and 4111 1111 1111 1111"]
    path = written(spark, tmp_path, texts, [(0, 1, 0)])
    found = {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in personal_data.op6_personal_data(spark, path).collect()}
    assert found == {i: (0, 0, 0, 0) for i in range(len(AWKWARD))} | {len(AWKWARD): (1, 0, 0, 1), len(AWKWARD) + 1: (0, 1, 1, 0)}
    kept = quality_rules.op8_quality_rules(spark, path).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(len(texts))) and all(r["kept"] is not None and not (r["base_failed"] and r["kept"]) for r in kept)


def test_warc_of_long_pages(spark, tmp_path):
    """Payloads of several megabytes, incompressible and not, equal and not, come back whole."""
    rng = random.Random(6)
    noise = rng.randbytes(1_500_000).hex()
    rows = [(1, "http://a/", noise), (2, "http://b/", noise), (3, "http://c/", "é" * 2_000_000), (4, "http://d/", noise + "x"), (5, "http://e/", None)]
    pages = clashing(pages_of(spark, rows)).withColumns({"payload": F.lit("no payload"), "record_type": F.lit("none")})
    archives, index = f"file://{tmp_path}/w", f"file://{tmp_path}/i"
    top = warc.build_index(warc.write_archives(pages, archives), index)
    got = {r["page_id"]: r for r in warc.read_records(warc.lookup(pages.select(warc.surt_of("url").alias("key"), "page_id"), top, index), archives).collect()}
    assert {i: r["refers_to"] for i, r in got.items()} == {1: 2, 2: None, 3: None, 4: None, 5: None}
    for i, _, html in rows:
        payload = (html or "").encode()
        assert bytes(got[i]["payload"]) == (b"" if i == 1 else payload)
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain_cover(rows, bins):
    """Sequential covering by trying every condition on every row; one row for each document."""
    holds = lambda rule, row: all(row[f] > b if above else row[f] <= b for f, above, b in rule)
    rules, left = [], sorted(rows)
    while len(rules) < quality_rules.RULES:
        grow, prune = [r for i, r in enumerate(left) if i % 3], left[::3]
        rule = []
        while len(rule) < quality_rules.CONDITIONS:
            inside = [r for r in grow if holds(rule, r[0])]
            bad, good = sum(r[1] for r in inside), sum(r[2] for r in inside)
            if not bad or not good:
                break
            gains = {}
            for f, top in enumerate(bins):
                for bound in range(top):
                    for above in (False, True):
                        b, g = (sum(r[k] for r in inside if holds([(f, above, bound)], r[0])) for k in (1, 2))
                        if b:
                            gains[f, above, bound] = b * (math.log2(b / (b + g)) - math.log2(bad / (bad + good)))
            first = max(gains, key=lambda c: (gains[c], c), default=None)
            if first is None or gains[first] < 0 or (gains[first], first) <= (0.0, ()):
                break
            rule.append(first)
        score = lambda r: (lambda b, g: (b - g) / max(1, b + g))(*(sum(x[k] for x in prune if holds(r, x[0])) for k in (1, 2)))
        while len(rule) > 1 and score(rule[:-1]) >= score(rule):
            rule = rule[:-1]
        bad, good = (sum(x[k] for x in left if rule and holds(rule, x[0])) for k in (1, 2))
        if bad < quality_rules.COVER or bad / (bad + good) < quality_rules.PRECISION:
            break
        rules.append(rule)
        left = [x for x in left if not holds(rule, x[0])]
    return rules


@pytest.mark.parametrize("seed", range(6))
def test_cover_equals_plain_cover(seed):
    """Two planted conjunctions and a single threshold under noise: the same rules in the same order, conjunctions among them."""
    rng = random.Random(seed)
    counts = {}
    for _ in range(700):
        row = tuple(rng.randint(0, 6) for _ in range(4))
        bad = (row[0] > 3 and row[1] <= 2) or row[2] > 5 or (row[3] <= 0 and row[1] > 3)
        if rng.random() < 0.01:
            bad = not bad
        b, g = counts.get(row, (0, 0))
        counts[row] = (b + bad, g + (not bad))
    rows = [(row, b, g) for row, (b, g) in counts.items()]
    rules = quality_rules.cover(rows, [6, 6, 6, 6])
    assert rules == plain_cover(rows, [6, 6, 6, 6])
    assert rules and any(len(r) > 1 for r in rules)
    caught = lambda row: any(quality_rules._covers(r, row) for r in rules)
    assert sum(b for row, b, _ in rows if caught(row)) >= 0.8 * sum(b for _, b, _ in rows)
