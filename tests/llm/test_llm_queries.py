"""Every registered query of the subpackage against its SQL, or against its contract's columns and folds, on the smallest tables."""

import re
import zlib

import pytest
from conftest import DATA

from panelforge.llm.queries import ORACLES, QUERIES

#: Columns of each contract; more may follow.
COLUMNS = {
    "op1_ngram_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op2_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op4_sharding": {"doc_id": "bigint", "shard": "string"},
    "op5_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op6_personal_data": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op7_decontamination": {"doc_id": "bigint", "item_id": "bigint", "similarity": "double"},
    "op8_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op9_mixing": {"doc_id": "bigint", "source": "string", "mix_position": "bigint"},
    "op10_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op11_whitening": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    "op12_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op13_filter_audit": {"part": "string", "filter_order": "string", "step": "int", **dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), "bigint")},
}


@pytest.fixture(scope="module")
def results(spark):
    found = {}

    def of(name):
        if name not in found:
            df = QUERIES[name](spark, DATA)
            found[name] = (dict(df.dtypes), df.collect())
        return found[name]

    return of


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_of_the_contract(results, spark, name):
    kinds, rows = results(name)
    assert COLUMNS[name].items() <= kinds.items()
    if name in ("op11_whitening", "op12_packing"):  # several rows an id
        table, key = ("embeddings", "vec_id") if name == "op11_whitening" else ("documents", "doc_id")
        ids = [r[key] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect()]
        assert sorted({r[key] for r in rows}) == sorted(ids)
    elif name not in ("op7_decontamination", "op13_filter_audit"):
        table = "pages" if name == "op3_warc" else "documents"
        key = "page_id" if name == "op3_warc" else "doc_id"
        ids = [r[key] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect()]
        assert sorted(r[key] for r in rows) == sorted(ids)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_of_the_sql(results, duck, name):
    kinds, rows = results(name)
    cols = sorted(kinds)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    assert sorted(tuple(r[c] for c in cols) for r in rows) == sorted(tuple(r[names.index(c)] for c in cols) for r in result.fetchall())


def test_folds_and_verdicts(results, spark):
    fold = lambda i, n: zlib.crc32(str(i).encode()) % n
    for r in results("op2_toxicity")[1]:
        assert r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    right = []
    for r in results("op10_language_id")[1]:
        text, lang = docs[r["doc_id"]]["text"], docs[r["doc_id"]]["lang"]
        assert r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", text or ""))
        if r["held_out"] and lang:
            right.append(r["lang_pred"] == lang)
    assert sum(right) / len(right) > 0.9
    for r in results("op8_quality_rules")[1]:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert len({r["mix_position"] for r in results("op9_mixing")[1]}) == len(docs)
