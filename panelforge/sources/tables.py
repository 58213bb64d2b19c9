"""Scans, sinks and the panel inputs derived from the driver's tables.

The adapters are SQL that Spark and DuckDB both run: ``bars`` (entity x date,
with dates numbered on their distinct values) from shipped line items by
supplier nation, ``contracts`` from the same rows as
an option chain, and ``preds``, an out-of-sample prediction table.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

RAW = "region nation customer supplier part orders lineitem events".split()

#: Entity x date aggregates of the line items; bars number the dates of these few rows.
DEALS = """
 SELECT n_name AS ticker, r_name AS sector, n_nationkey, CAST(date_trunc('{grain}', l_shipdate) AS DATE) AS date,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS prc,
  CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS vol
 FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
 GROUP BY 1, 2, 3, 4"""

BARS = """
SELECT ticker, sector, date, date_idx, prc, prc / LAG(prc) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret, vol,
 vol * 1000 AS mktcap, CAST(12 + (date_idx * 7) % 17 AS DOUBLE) AS vix_close, CAST(14 + (date_idx * 5) % 13 AS DOUBLE) AS vix3m_close,
 CAST(2 AS DOUBLE) AS tbill_rate, CAST(((n_nationkey + 13 - date_idx % 13) % 13) * 7 AS DOUBLE) AS days_to_next_earnings
FROM (SELECT g.*, i.date_idx FROM {deals} g
 JOIN (SELECT date, ROW_NUMBER() OVER (ORDER BY date) - 1 AS date_idx FROM (SELECT DISTINCT date FROM {deals}) x) i ON g.date = i.date) h"""

CONTRACTS = """
SELECT c.*, CASE WHEN is_call = 1 THEN 0.5 - 2 * (moneyness - 1) ELSE -0.5 - 2 * (moneyness - 1) END AS delta,
 0.02 * (1 - ABS(moneyness - 1)) AS gamma, 0.1E0 AS vega,
 underlying_price * (0.03 + GREATEST(0, CASE WHEN is_call = 1 THEN 1 - moneyness ELSE moneyness - 1 END)) AS mid_price
FROM (
 SELECT l.ticker, l.date, l.is_call, CAST(l.moneyness AS DOUBLE) AS moneyness, CAST(l.dte AS INT) AS dte,
  CAST(l.moneyness AS DOUBLE) * MAX(prc) AS strike, MAX(prc) AS underlying_price,
  CAST(SUM(volume) AS BIGINT) AS volume, CAST(SUM(oi) AS BIGINT) AS open_interest,
  0.15 + 2 * CAST(SUM(CAST(l_discount AS DECIMAL(10,4))) AS DOUBLE) / COUNT(l_discount) + 0.5 * POWER(CAST(l.moneyness AS DOUBLE) - 1, 2) AS impl_volatility,
  CAST(SUM(CAST(l_tax AS DECIMAL(10,4))) AS DOUBLE) / COUNT(l_tax) AS spread_pct
 FROM (
  SELECT n_name AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
   CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS is_call,
   0.80 + 0.05 * (l_partkey % 9) AS moneyness, 30 * (1 + l_orderkey % 4) AS dte,
   CAST(l_quantity AS INT) AS volume, (l_partkey * 7 + l_orderkey * 3) % 500 AS oi, l_discount, l_tax
  FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey) l
 JOIN {bars_m} b ON l.ticker = b.ticker AND l.date = b.date
 GROUP BY 1, 2, 3, 4, 5) c"""

#: Contracts with a lifetime: listed by quarter, three or six months long, seen in the months between; a month in five an entity isn't observed.
LISTED = """
SELECT ticker, date, is_call, strike_no, expiration, CAST(SUM(volume) AS BIGINT) AS volume, CAST(SUM(oi) AS BIGINT) AS open_interest FROM (
 SELECT n_name AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS is_call, l_partkey % 9 AS strike_no,
  CAST(CASE WHEN l_orderkey % 2 = 0 THEN CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL '3' MONTH ELSE CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL '6' MONTH END AS DATE) AS expiration,
  CAST(l_quantity AS INT) AS volume, (l_partkey * 7 + l_orderkey * 3) % 500 AS oi
 FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey WHERE (n_nationkey + month(l_shipdate)) % 5 <> 0) l
GROUP BY 1, 2, 3, 4, 5"""

#: Three feature sets of one model; y_raw is a hundredth of the next period's return. Values are rounded so that float noise can't split ties.
PREDS = """
SELECT 'rule' AS model, feature_set, 'rolling' AS scheme, horizon, ticker, sector, date, date_idx, pred, y_raw,
 ROUND(y_raw - AVG(y_raw) OVER (PARTITION BY feature_set, horizon, date), 9) AS y_demeaned, vix_close, days_to_next_earnings, spread
FROM (
 SELECT s.feature_set, h.horizon, ticker, sector, date, date_idx, vix_close, days_to_next_earnings, 0.0005 * (1 + date_idx % 4) AS spread,
  ROUND(CASE s.feature_set WHEN 'A' THEN -ret WHEN 'B' THEN prc / prev4 - 1 ELSE vol / prev_vol - 1 END / 10, 9) AS pred,
  ROUND(CASE h.horizon WHEN 1 THEN next1 / prc - 1 ELSE next3 / prc - 1 END / 100, 9) AS y_raw
 FROM (SELECT b.*, LAG(prc, 4) OVER w AS prev4, LAG(vol) OVER w AS prev_vol, LEAD(prc, 1) OVER w AS next1, LEAD(prc, 3) OVER w AS next3
  FROM {bars} b WINDOW w AS (PARTITION BY ticker ORDER BY date)) x
 CROSS JOIN (SELECT 'A' AS feature_set UNION ALL SELECT 'B' UNION ALL SELECT 'C') s CROSS JOIN (SELECT 1 AS horizon UNION ALL SELECT 3) h) y
WHERE pred IS NOT NULL AND y_raw IS NOT NULL"""


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local master (one machine, as in tests) gets
    a temporary folder; a cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="panelforge-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str = "panel") -> DataFrame:
    """Write to the shared folder and read back: one computation for several readers, and no lineage."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan(spark: SparkSession, sf_dir: str, table: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; only the named columns are read."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def _sql(spark: SparkSession, sf_dir: str, text: str, **frames) -> DataFrame:
    return spark.sql(text, **{t: scan(spark, sf_dir, t) for t in RAW if "{" + t + "}" in text}, **frames)


def bars(spark: SparkSession, sf_dir: str, grain: str = "week") -> DataFrame:
    """Bars by entity and date. Line items are read once: their aggregates, a row for each entity and date, are written."""
    return _sql(spark, sf_dir, BARS, deals=materialize(_sql(spark, sf_dir, DEALS.replace("{grain}", grain)), "deals"))


def contracts(spark: SparkSession, sf_dir: str, months: DataFrame | None = None) -> DataFrame:
    """The option chain; ``months`` are the bars by month where they are at hand."""
    return _sql(spark, sf_dir, CONTRACTS, bars_m=bars(spark, sf_dir, "month") if months is None else months)


def chain_and_bars(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The option chain and the bars by month, which it is built on."""
    months = bars(spark, sf_dir, "month")
    return contracts(spark, sf_dir, months), months


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts with an expiry, by the months in which they are observed."""
    return _sql(spark, sf_dir, LISTED)


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, PREDS, bars=bars(spark, sf_dir))


def ctes(*names: str) -> str:
    """The adapters as DuckDB common table expressions."""
    raw = {t: t for t in RAW}
    texts = {
        "deals": DEALS.format(grain="week", **raw),
        "deals_m": DEALS.format(grain="month", **raw),
        "bars": BARS.format(deals="deals"),
        "bars_m": BARS.format(deals="deals_m"),
        "contracts": CONTRACTS.format(bars_m="bars_m", **raw),
        "preds": PREDS.format(bars="bars", **raw),
        "listed": LISTED.format(**raw),
    }
    needs = {"contracts": ["deals_m", "bars_m"], "preds": ["deals", "bars"], "bars": ["deals"], "bars_m": ["deals_m"]}
    order = list(dict.fromkeys(x for n in names for x in [*needs.get(n, []), n]))
    return "WITH " + ",\n".join(f"{n} AS ({texts[n]})" for n in order)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Append and keep the last row of each key: rows of ``new`` win."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    rest = [F.col(c).desc_nulls_last() for c in old.columns if c not in keys]
    return both.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_batch"), *rest))).where("_rn = 1").drop("_rn", "_batch")


def pending(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the grid that the result table lacks."""
    return grid.join(done.select(*keys), keys, "left_anti")


def _hadoop_path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, name: str) -> bool:
    path, store = _hadoop_path(spark, name)
    return store.exists(path)


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that ``df`` has rows of, and no others; each is put in place when all its rows are written.

    Rows are dealt by partition first, large ones split, so that a partition has few files.
    """
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert_partitions(new: DataFrame, path: str, keys: list[str], by: list[str]) -> int:
    """Upsert into a table partitioned by ``by``: only partitions that ``new`` touches are read and rewritten. Returns their number.

    Rows of ``new`` win by key; a key stays in its partition, so ``by`` is part of ``keys``.
    """
    spark = new.sparkSession
    new = materialize(new, "upsert-new")
    touched = new.select(*by).distinct()
    if path_exists(spark, path):
        old = spark.read.parquet(path).select(*new.columns).join(F.broadcast(touched), by, "left_semi")  # prunes partitions at run time
        new = materialize(upsert(old, new, keys), "upsert")  # a table can't be read while it is overwritten
    overwrite_partitions(new, path, by)
    return touched.count()


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Parquet sink with one folder for each value of ``by``, so that later scans prune."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def csv_round_trip(df: DataFrame) -> DataFrame:
    """CSV sink and source with an explicit schema."""
    path = f"{shared_dir(df.sparkSession)}/csv-{uuid.uuid4().hex}"
    df.write.csv(path, header=True)
    return df.sparkSession.read.csv(path, header=True, schema=df.schema)
