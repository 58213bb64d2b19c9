"""Operator 5: secret scans through an incremental blob ledger.

Every historical version of every path is content-addressed. Only (blob, rule
version) pairs that the ledger lacks are scanned, each blob once however many
paths hold it, and findings are joined back to all paths. DataFrame functions
only.

Scale: identities move as hashes. The text of one holder of each unseen blob
moves once, unless Spark finds the written table of unseen ids small enough to broadcast. A
blob that a third of all rows share is one row in the scan and a narrow row a
path in the join back, which AQE splits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelforge.llm import spans
from panelforge.llm.common import exists, fresh_path, materialize, read


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, a cheap test that any text with a match passes, and the least length of a group."""

    kind: str
    pattern: str
    hint: str
    group: int = 0
    least: int = 0


#: Rules with their version; the first three are the base kinds, in order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i)passw|secret|token|api_?key", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", r"[0-9a-f]{24}", 0, 24),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]{36}", 0, 40),
    # a token begins after a character that no token has, and no run is read twice: linear in a text's length
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]++", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10}", 0, 0),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE", 0, 0),
)
RULES = BASE + MORE
VERSION = "1"
LEDGER = f"blob string, rule_version string, found {spans.SPAN}"
KINDS = tuple(r.kind for r in RULES)


def _long_enough(least: int):
    return lambda span: F.length(span["value"]) >= least


def scan(content: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans that the rules find in a text, rule by rule."""
    parts = []
    for r in rules:
        found = spans.find(content, r.kind, r.pattern, r.group)
        parts.append(F.when(content.rlike(r.hint), F.filter(found, _long_enough(r.least))).otherwise(spans.none()))
    return F.concat(*parts)


def blob_id(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256)


def ledger_update(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = VERSION) -> DataFrame:
    """New ledger rows ``(blob, rule_version, found)`` of ``versions(path, version, content, ...)``.

    ``ledger`` has the same columns; its pairs are not scanned again, and where
    no pair is unseen no text is read. Null content counts as empty; repeated
    rows and equal contents are one blob. Other columns are ignored.
    """
    named = versions.select("path", "version", blob_id(F.col("content")).alias("blob"))
    holders = named.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at"))
    if ledger is not None:
        holders = holders.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    holders = materialize(holders.select(F.col("blob"), F.col("at.path").alias("in_path"), F.col("at.version").alias("in_version")), "secret-holders")
    if holders.isEmpty():
        return versions.sparkSession.createDataFrame([], LEDGER)
    texts = versions.select("path", "version", F.coalesce("content", F.lit("")).alias("content"))
    chosen = texts.join(holders, F.col("path").eqNullSafe(F.col("in_path")) & F.col("version").eqNullSafe(F.col("in_version")) & (blob_id(F.col("content")) == F.col("blob")))
    found = chosen.select("blob", F.lit(rule_version).alias("rule_version"), scan(F.col("content"), rules).alias("found"))
    return found.dropDuplicates(["blob"])


def scan_batch(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, rule_version: str = VERSION) -> DataFrame:
    """The ledger kept at ``path`` after this batch of versions, whose unseen blobs are scanned and appended.

    The first batch starts the ledger. A batch that is given again, or that
    brings known blobs under new paths or versions, scans nothing.
    """
    spark = versions.sparkSession
    read_back = lambda: spark.read.schema(LEDGER).parquet(path)
    new = ledger_update(versions, read_back() if exists(spark, path) else None, rules, rule_version)
    new.write.mode("append").parquet(path)
    return read_back()


def findings(versions: DataFrame, ledger: DataFrame, rule_version: str = VERSION) -> DataFrame:
    """``(path, version, blob, found)`` for every row of ``versions``; ``found`` may be empty."""
    named = versions.select("path", "version", blob_id(F.col("content")).alias("blob"))
    # a batch that was appended twice after a failure must not double its findings
    hits = ledger.where((F.col("rule_version") == rule_version) & (F.size("found") > 0)).select("blob", "found").dropDuplicates(["blob"])
    return named.join(hits, "blob", "left").select("path", "version", "blob", F.coalesce("found", spans.none()).alias("found"))


def op5_secret_scan(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """All documents through the ledger at ``path`` (by default a fresh one), in the two batches that they arrive in.

    The batches are the rows of each parity of crc32(doc_id); the second scans
    only blobs that the first did not hold. Null texts count as empty, null ids
    are a path of their own; repeated rows each get a row.
    """
    docs = read(spark, sf_dir, "documents")
    arrived = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2).cast("int")
    versions = docs.select(F.col("doc_id").alias("path"), arrived.alias("version"), F.col("text").alias("content"))
    path = path or fresh_path(spark, "secret-ledger")
    for batch in (0, 1):
        ledger = scan_batch(versions.where(F.col("version") == batch), path)
    base = tuple(r.kind for r in BASE)
    out = findings(versions, ledger).withColumn("sorted", spans.by_start(F.col("found"), KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(
        F.col("path").alias("doc_id"),
        *[count(k) for k in base],
        F.sha2(spans.joined(F.filter("sorted", lambda s: s["kind"].isin(*base))).cast("binary"), 256).alias("base_sha256"),
        spans.joined(F.col("sorted")).alias("spans"),
    )
