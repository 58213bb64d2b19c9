"""The pipeline keeps what each stage should keep."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from panelforge.llm import decontamination, language_id, ngram_join
from panelforge.llm.common import read

DATA = "/root/testdata/sf0.001"


def test_stages_and_their_columns(spark):
    docs = read(spark, DATA, "documents")
    columns = docs.columns
    seen = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA), f"t-{name}")
        seen.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "decontamination", "mixing", "sharding"]
    assert seen[3] == seen[4] == seen[5] and 0 < seen[3] < seen[0]
    assert "shard" in docs.columns


def test_run_drops_copies_and_leaks_only(spark):
    docs = read(spark, DATA, "documents")
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()}
    classes = {r["doc_id"]: r["component_id"] for r in ngram_join.classes(docs).collect()}
    leaks = {r["doc_id"] for r in decontamination.matches(docs, read(spark, DATA, "benchmark")).collect()}
    letters = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert kept == {d for d, c in classes.items() if d == c and d not in leaks and d in letters}


def test_empty_documents(spark):
    docs = read(spark, DATA, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA), f"e-{name}")
    assert docs.count() == 0


def test_stages_on_awkward_rows(spark):
    """Null ids, repeated rows, very long texts and extra columns with clashing names: no crash, all columns kept, clean rows kept."""
    prose = "the quick brown fox jumps over the lazy dog near the old river bank while many people watch from the other side"
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, prose), (1, prose), (None, prose + " again"), (None, None), (2, ""), (3, long), (4, long + " end"), (5, "été noël forêt"), (5, "another text under the same number")]
    docs = spark.createDataFrame([(i, t, "en", None if k % 2 else "web", None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("set_key", "component", "row", "found", "mix_hash", "slot", "lang_pred", "score", "bucket", "words"):
        docs = docs.withColumn(name, F.lit(7))
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA), f"w-{name}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    # one of the prose rows, one of the long ones, and both texts under number 5
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:8]) for r in docs.collect()) == [(1, "the quic"), (3, "word0 wo"), (5, "another "), (5, "été noël")]


def test_long_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """Batches are bounded by bytes, not by rows alone: 20 MB of texts in one partition reach a worker in parts, and every row does."""

    def weigh(langs, model, least):
        def run(batches):
            for batch in batches:
                yield batch.set_column(4, "n_chars", pa.array([batch.nbytes] * batch.num_rows, pa.int64()))

        return run

    key, size = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
    docs = spark.range(2000).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    monkeypatch.setattr(language_id, "_judge", weigh)
    try:
        spark.conf.unset(key)
        seen = [r["n_chars"] for r in corpus_pipeline.identify(spark, docs, DATA).select("n_chars").collect()]
        assert len(seen) == 2000 and max(seen) < 1.25 * size
        spark.conf.set(key, "1m")
        corpus_pipeline.bound_batches(spark)  # the session's own limit stays
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
