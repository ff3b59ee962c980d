"""The input tables as panels: one definition for Spark and one, of the same numbers, for the SQL twins."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosspanel.operators import calendars
from crosspanel.operators.clean import clean
from crosspanel.operators.returns import ReturnModel, forward_returns

HORIZONS = [1, 3]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster needs a shared folder: set spark.checkpoint.dir")
        found = "file://" + tempfile.mkdtemp(prefix="crosspanel-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly prices by supplier, from order lines; sums are of whole numbers, so they don't depend on order.

    Every branch of a query works on this panel, so it is kept once made, in memory and on disk beyond that; a second
    query finds it again.
    """
    line = read(spark, sf_dir, "lineitem")
    # amounts of two digits as whole cents and percents: sums of longs are exact, and cheaper than those of wide decimals
    whole = lambda c: F.rint(F.col(c) * 100).cast("long")
    t = line.select(
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date"), "l_suppkey", whole("l_extendedprice").alias("p"),
        whole("l_quantity").alias("q"), whole("l_discount").alias("dsc"), (F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))).alias("u"),
    )
    a = t.groupBy("date", "l_suppkey").agg(
        F.sum("p").alias("p"), F.sum(F.col("p") * (100 - F.col("dsc"))).alias("net"), F.sum("q").alias("q"), F.max("u").alias("mx"), F.min("u").alias("mn"), F.count("*").alias("n"),
    )
    volume = F.col("q").cast("double") / 100
    c, o = F.col("p").cast("double") / 100 / volume, F.col("net").cast("double") / 10000 / volume
    raw = a.select(
        "date", F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("asset"), o.alias("raw_open"), F.greatest(F.col("mx"), o, c).alias("raw_high"),
        F.least(F.col("mn"), o, c).alias("raw_low"), c.alias("raw_close"), volume.alias("volume"), "n",
    )
    raw = raw.persist(StorageLevel.MEMORY_AND_DISK)
    return raw.withColumns({"adj_factor": F.lit(1.0)} | {f"adj_{k}": F.col(f"raw_{k}") for k in ("open", "high", "low", "close")})


def factor(prices: DataFrame) -> DataFrame:
    """A factor of the same month: open over close."""
    return prices.select("date", "asset", (F.col("raw_open") / F.col("raw_close")).alias("factor"))


def second_factor(prices: DataFrame) -> DataFrame:
    """Another: log volume."""
    return prices.select("date", "asset", F.log("volume").alias("factor"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, region of each supplier."""
    s, n, r = (read(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    joined = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    return joined.select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("asset"), F.col("r_name").alias("grp"))


def calendar(prices: DataFrame) -> DataFrame:
    """Months that any supplier has."""
    return calendars.from_panels(prices)


def sample(spark: SparkSession, sf_dir: str, with_groups: bool = False) -> DataFrame:
    """The cleaned sample: factor, forward_return_1 and _3, and perhaps ln_volume and grp."""
    px = prices(spark, sf_dir)
    data = clean(factor(px), forward_returns(px, calendar(px), HORIZONS, model=ReturnModel())).data
    data = data.select("date", "asset", "factor", *(f"forward_return_{h}" for h in HORIZONS))
    if with_groups:
        data = data.join(px.select("date", "asset", F.log("volume").alias("ln_volume")), ["date", "asset"])
        data = data.join(groups(spark, sf_dir), "asset", "left").select("date", "asset", "factor", *(f"forward_return_{h}" for h in HORIZONS), "ln_volume", "grp")
    return data


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, asset, event_type: months in which a supplier's volume was beyond 1.5 times its mean."""
    px = prices(spark, sf_dir)
    mean = px.groupBy("asset").agg((F.sum("volume") / F.count("*")).alias("m"))
    return px.join(mean, "asset").where(F.col("volume") > 1.5 * F.col("m")).select("date", "asset", F.lit("surge").alias("event_type"))


def xdxr(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Ex-rights events made up from the panel: every twelfth month."""
    key = F.col("asset").cast("int")
    at = calendars.with_pos(prices.select("date", "asset"), calendar).where(F.col("pos") % 12 == 6)
    return at.select("date", "asset", F.lit(1).alias("category"), (0.1 * (key % 5)).alias("fenhong"), F.lit(0.0).alias("peigu"), F.lit(0.0).alias("peigujia"), (1.0 + key % 3).alias("songzhuangu"))


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Numbers as results carry them: doubles rounded, whole numbers long."""
    def cell(f: T.StructField):
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return (F.round(c.cast("double"), digits) + 0.0).alias(f.name)
        return c.cast("long").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType)) else c
    return df.select(*(cell(f) for f in df.schema))


PX_SQL = """
t AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS asset,
  CAST(l_extendedprice AS DECIMAL(12,2)) p, CAST(l_quantity AS DECIMAL(12,2)) q, CAST(l_discount AS DECIMAL(4,2)) dsc,
  l_extendedprice / nullif(l_quantity, 0) u FROM lineitem),
a AS (SELECT date, asset, CAST(sum(p) AS DOUBLE) / CAST(sum(q) AS DOUBLE) c, CAST(sum(p * (1 - dsc)) AS DOUBLE) / CAST(sum(q) AS DOUBLE) o,
  max(u) mx, min(u) mn, CAST(sum(q) AS DOUBLE) volume, count(*) n FROM t GROUP BY date, asset),
px AS (SELECT date, asset, o raw_open, greatest(mx, o, c) raw_high, least(mn, o, c) raw_low, c raw_close, volume, CAST(n AS BIGINT) n FROM a),
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM px))"""

DATA_SQL = PX_SQL + """,
fr AS (SELECT px.date, asset, pos, raw_open / raw_close AS factor, ln(volume) AS ln_volume, raw_open, raw_close,
  first_value(raw_open) OVER (w RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) e,
  first_value(raw_open) OVER (w RANGE BETWEEN 2 FOLLOWING AND 2 FOLLOWING) x1,
  first_value(raw_open) OVER (w RANGE BETWEEN 4 FOLLOWING AND 4 FOLLOWING) x3
  FROM px JOIN cal USING (date) WINDOW w AS (PARTITION BY asset ORDER BY pos)),
ret AS (SELECT date, asset, pos, factor, ln_volume, x1 / e - 1 AS forward_return_1, x3 / e - 1 AS forward_return_3 FROM fr),
data AS (SELECT * FROM ret WHERE forward_return_1 IS NOT NULL AND forward_return_3 IS NOT NULL),
gdata AS (SELECT d.*, r_name AS grp FROM data d LEFT JOIN (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') asset, r_name FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) USING (asset)),
long AS (SELECT date, asset, factor, h AS horizon, CASE h WHEN 1 THEN forward_return_1 ELSE forward_return_3 END AS r FROM data, (VALUES (1), (3)) v(h))"""

RANKED_SQL = DATA_SQL + """,
ranked AS (SELECT *, rank() OVER (PARTITION BY date, horizon ORDER BY factor) + (count(*) OVER (PARTITION BY date, horizon, factor) - 1) / 2.0 AS rf,
  rank() OVER (PARTITION BY date, horizon ORDER BY r) + (count(*) OVER (PARTITION BY date, horizon, r) - 1) / 2.0 AS rr FROM long),
ic AS (SELECT date, horizon, CASE WHEN count(*) >= 3 AND min(rf) < max(rf) AND min(rr) < max(rr) THEN round(corr(rf, rr), 12) + 0.0 END AS ic, count(*) AS n FROM ranked GROUP BY date, horizon)"""

QUANT_SQL = DATA_SQL + """,
edges AS (SELECT *, list_distinct(quantile_cont(factor, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) OVER (PARTITION BY date)) es, count(factor) OVER (PARTITION BY date) sz FROM data),
lab AS (SELECT date, asset, factor, ln_volume, forward_return_1, forward_return_3,
  CASE WHEN sz >= 5 AND len(es) > 1 THEN greatest(1, len(list_filter(es, lambda e: factor > e))) END AS factor_quantile FROM edges),
qr AS (SELECT date, factor_quantile, avg(forward_return_1) forward_return_1, avg(forward_return_3) forward_return_3, count(*) AS count
  FROM lab WHERE factor_quantile IS NOT NULL GROUP BY date, factor_quantile)"""


def sql(ctes: str, body: str) -> str:
    """A query over shared common table expressions."""
    body = body.strip()
    return f"WITH {ctes.strip()}{body}" if body.startswith(",") else f"WITH {ctes.strip()}\n{body}"
