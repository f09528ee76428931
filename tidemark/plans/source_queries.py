"""Source, ingest and streaming queries, and their SQL. Responses are written from the tables, then read back."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import values
from tidemark.operators import ingest
from tidemark.plans.roles import ctes, role
from tidemark.sources import providers, store
from tidemark.streaming import collect, cycle


def _listed(spark: SparkSession, sf: str, *fields: str) -> DataFrame:
    """Each nation's bars in order, as arrays of one response."""
    rows = role(spark, sf, "bars").groupBy(F.concat(F.lit("N"), F.col("security")).alias("request_id"))
    return rows.agg(F.array_sort(F.collect_list(F.struct("trading_date", *fields))).alias("r"))


def _plain(df: DataFrame) -> DataFrame:
    return df.where("issue is null").select("request_id", "trading_date", "open", "high", "low", "close", "volume", "observation_status")


def chart_bodies(spark: SparkSession, sf: str) -> DataFrame:
    fields = ("open", "high", "low", "close", "volume")
    rows = _listed(spark, sf, *fields)
    quote = F.struct(*[F.col(f"r.{f}").alias(f) for f in fields])
    at = F.transform("r", lambda x: F.unix_timestamp(x["trading_date"].cast("timestamp")) + 50400)
    result = F.struct(F.struct(F.lit("USD").alias("currency"), F.lit("America/New_York").alias("exchangeTimezoneName")).alias("meta"), at.alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))
    return rows.select("request_id", F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart"))).alias("body"))


def keyed_bodies(spark: SparkSession, sf: str) -> DataFrame:
    rows = role(spark, sf, "bars").withColumn("trading_date", F.col("trading_date").cast("string"))
    text = F.map_from_entries(F.array(*[F.struct(F.lit(f"{k}. {c}"), F.col(c).cast("string")) for k, c in enumerate(("open", "high", "low", "close", "volume"), 1)]))
    days = rows.groupBy(F.concat(F.lit("N"), F.col("security")).alias("request_id")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("trading_date"), text))).alias("d"))
    return days.select("request_id", F.to_json(F.struct(F.col("d").alias("Time Series (Daily)"))).alias("body"))


def array_bodies(spark: SparkSession, sf: str) -> DataFrame:
    rows = _listed(spark, sf, "open", "high", "low", "close", "volume")
    body = F.to_json(F.transform("r", lambda x: F.struct(x["trading_date"].cast("string").alias("date"), *[x[c].alias(c) for c in ("open", "high", "low", "close", "volume")])))
    return rows.select("request_id", body.alias("body"))


def csv_bodies(spark: SparkSession, sf: str) -> DataFrame:
    rows = _listed(spark, sf, "open", "high", "low", "close", "volume")
    lines = F.transform("r", lambda x: F.concat_ws(",", x["trading_date"].cast("string"), *[x[c].cast("string") for c in ("open", "high", "low", "close", "volume")]))
    return rows.select("request_id", F.concat(F.lit("Date,Open,High,Low,Close,Volume\n"), F.array_join(lines, "\n")).alias("body"))


def chart(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(providers.chart_json(chart_bodies(spark, sf)))


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(providers.keyed_json(keyed_bodies(spark, sf)))


def array(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(providers.array_json(array_bodies(spark, sf), "1990-01-01", "2010-12-31"))


def csv(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(providers.csv_text(csv_bodies(spark, sf)))


#: The first and last day that collected requests ask for.
ASKED = ("1993-01-01", "1996-12-31")


def _landed(spark: SparkSession, sf: str) -> DataFrame:
    """What a collector lands: for each nation a response in the form of its source, some of them failed or torn, and later a request to be served from what is stored."""
    made = {"chart_json": chart_bodies, "keyed_json": keyed_bodies, "array_json": array_bodies, "csv": csv_bodies}
    rows = None
    for k, (source, bodies) in enumerate(made.items()):
        some = bodies(spark, sf).withColumns({"n": F.substring("request_id", 2, 9).cast("int"), "source": F.lit(source)}).where(F.col("n") % 4 == k)
        rows = some if rows is None else rows.unionByName(some)
    n = F.col("n")
    source = F.when(n == 24, "unheard").otherwise(F.col("source"))
    common = F.map_from_entries(F.array(*[F.struct(F.lit(k), v) for k, v in {"source": source, "symbol": F.concat(F.lit("N"), n), "secret": F.lit("x")}.items()]))
    period = F.map_concat(common, F.create_map(F.lit("start"), F.lit(ASKED[0]), F.lit("end"), F.lit(ASKED[1])))
    parameters = F.when(F.col("source") == "chart_json", period).otherwise(common)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + n)
    torn = F.when(n % 10 == 5, F.substring("body", 1, 40)).when(n % 10 == 6, "").otherwise(F.col("body"))
    code = F.when(n % 10 == 7, 429).when(n % 10 == 8, 404).otherwise(200)
    fetched = rows.select(parameters.alias("parameters"), code.alias("http_status"), F.when(n % 10 == 9, "timeout").alias("error"), at.alias("fetched_at"), at.alias("recorded_at"), F.when(n % 10 != 9, torn).alias("body"), F.lit(1).alias("turn"))
    later = at + F.make_dt_interval(days=F.lit(1))
    return fetched.unionByName(rows.select(parameters.alias("parameters"), F.lit(None).cast("int").alias("http_status"), F.lit(None).cast("string").alias("error"), later.alias("fetched_at"), later.alias("recorded_at"), F.lit(None).cast("string").alias("body"), F.lit(2).alias("turn")))


def _collected(spark: SparkSession, sf: str, sink: str) -> DataFrame:
    """A sink after two runs of one stream, the second with newer code, over responses and then over requests without any."""
    folder = store.scratch(spark)
    landed = store.stored(_landed(spark, sf))
    for turn in (1, 2):
        landed.where(F.col("turn") == turn).drop("turn").repartition(3).write.mode("append").json(f"{folder}/landing")
        stream = cycle.landing(spark, f"{folder}/landing", collect.LANDED)
        collect.collect(stream, f"{folder}/store", f"{folder}/checkpoint", code_version=str(turn)).awaitTermination()
    return collect.committed(spark, f"{folder}/store", sink)


def collected_manifests(spark: SparkSession, sf: str) -> DataFrame:
    rows = _collected(spark, sf, "manifests")
    return rows.select(F.col("request_parameters")["symbol"].alias("symbol"), "source", "network_performed", "status", "n_bars", "first_date", "last_date", F.map_contains_key("request_parameters", "secret").alias("leaks"), F.col("origin_receipt_id").isNotNull().alias("has_origin"))


def collected_bars(spark: SparkSession, sf: str) -> DataFrame:
    return _collected(spark, sf, "bars").groupBy("source", "trading_date").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"), F.max("close").alias("high"))


def directory(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/supplier.parquet").groupBy(F.col("s_nationkey").cast("string").alias("request_id"))
    lines = rows.agg(F.array_sort(F.collect_list(F.concat_ws("|", F.concat(F.lit("S"), F.col("s_suppkey")), "s_name", F.lit("Q"), F.lit("N")))).alias("l"))
    body = F.concat(F.lit("Symbol|Security Name|Market Category|Test Issue\n"), F.array_join("l", "\n"), F.lit("\nFile Creation Time: 0101202600:00|||"))
    return providers.directory_text(lines.select("request_id", body.alias("body")))


def categories(spark: SparkSession, sf: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, (200, 401, 403, 404, 429, 500, 302, 418))), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return spark.read.parquet(f"{sf}/orders.parquet").select(providers.http_category(code).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def strict_values(spark: SparkSession, sf: str) -> DataFrame:
    """How many texts made by rule parse as instants, days and numbers."""
    k = F.col("o_orderkey") % 6
    d = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")
    stamp = F.when(k == 0, F.concat(d, F.lit("T10:00:00Z"))).when(k == 1, F.concat(d, F.lit("T10:00:00"))).when(k == 2, F.concat(d, F.lit("T10:00:00+02:00"))).when(k == 3, d).when(k == 4, F.lit("2024-13-01T00:00:00Z")).otherwise(F.lit(None))
    day = F.when(k == 0, d).when(k == 1, F.lit("2024-1-2")).when(k == 2, F.lit("2023-02-29")).otherwise(F.lit(""))
    num = F.when(k == 0, F.lit("12.5")).when(k == 1, F.lit("true")).when(k == 2, F.lit("NaN")).when(k == 3, F.lit("1e3")).when(k == 4, F.lit("Infinity")).otherwise(F.lit("7"))
    t = spark.read.parquet(f"{sf}/orders.parquet").select(values.instant(stamp).alias("i"), values.day(day).alias("d"), values.number(num).alias("n"), values.number(num, integer=True).alias("m"))
    return t.agg(*[F.count(c).alias(n) for c, n in (("i", "n_instants"), ("d", "n_days"), ("n", "n_numbers"), ("m", "n_integers"))])


def fan_out(spark: SparkSession, sf: str) -> DataFrame:
    rows = role(spark, sf, "bars").withColumn("adjusted_close", F.when(F.col("volume") % 3 == 0, F.col("close") * 0.9))
    return ingest.price_series(rows).groupBy("price_kind").agg(F.count("*").alias("n"), F.count("open").alias("n_open"), F.round(F.sum("close"), 4).alias("sum_close"))


def securities(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(
        F.lit("alpha").alias("source"),
        F.col("c_custkey").cast("string").alias("local_instrument_id"),
        F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("CIK: "), F.col("c_custkey"))).when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("FIGI"), (F.col("c_custkey") / 2).cast("bigint"))).alias("external_security_id"),
        F.when(F.col("c_custkey") % 7 != 0, F.lit("notice")).alias("evidence"),
    )
    return ingest.resolved_security(rows).groupBy("identifier_verification").agg(F.count("*").alias("n"), F.count_distinct("security_id").alias("n_securities"))


def origins(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_orderkey") % 4000).alias("request_id"), (F.col("o_orderkey") % 3).alias("raw_sha256"), F.lit(0).alias("fetched_at"), F.col("o_orderkey").alias("receipt_id"))
    originals = orders.where("receipt_id % 7 <> 0")
    out = ingest.matching_origins(orders.drop("receipt_id"), originals)
    return out.groupBy(F.coalesce("origin_issue", F.lit("matched")).alias("issue")).agg(F.count("*").alias("n"))


def action_faults(spark: SparkSession, sf: str) -> DataFrame:
    rows = role(spark, sf, "dated_actions").withColumn("event_date", F.col("ex_date")).withColumn("amount", F.when(F.col("amount") < 0.05, -1.0).otherwise(F.col("amount")))
    out = ingest.action_issues(rows, ["security", "event_type", "event_date"])
    return out.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def appended_once(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream, appended to a table once by user and type, although the stream runs again from its checkpoint and once from none."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    folder = store.scratch(spark)
    for checkpoint in ("first", "first", "none"):
        stream = spark.readStream.schema(schema).parquet(f"{sf}/event*.parquet").select("user_id", "event_type")
        cycle.append_once(stream, f"{folder}/table", ["user_id", "event_type"], f"{folder}/{checkpoint}").awaitTermination()
    return spark.read.parquet(f"{folder}/table").groupBy("event_type").agg(F.count("*").alias("n"))


def cached(spark: SparkSession, sf: str) -> DataFrame:
    rows = role(spark, sf, "receipts").withColumnRenamed("received_at", "recorded_at").withColumn("recorded_at", F.col("recorded_at") + F.make_dt_interval(secs=F.substring("receipt_id", 2, 10).cast("int") % 1000))
    return store.cached_responses(rows).select("request_id", "recorded_at", "status")


def _bars_sql() -> str:
    return ctes("bars") + "\nSELECT 'N' || security AS request_id, trading_date, open, high, low, close, volume, CASE WHEN volume = 0 THEN 'reported_zero_volume' ELSE 'observed' END AS observation_status FROM bars"


#: Requests by rule, and what becomes of each fetched one.
_COLLECTED = f"""
, r AS (SELECT DISTINCT security AS n, ['chart_json', 'keyed_json', 'array_json', 'csv'][security % 4 + 1] AS kind FROM bars)
, f AS (SELECT n, CASE WHEN n = 24 THEN 'unheard' ELSE kind END AS source, CASE WHEN n % 10 = 9 THEN 'timeout' WHEN n % 10 = 7 THEN 'rate_limited' WHEN n % 10 = 8 THEN 'not_found' WHEN n % 10 = 6 THEN 'empty_response' WHEN n = 24 THEN 'unknown_provider'
  WHEN n % 10 = 5 THEN CASE kind WHEN 'csv' THEN 'invalid_date' ELSE 'schema_change' END ELSE 'success' END AS status FROM r)
, b AS (SELECT n, source, trading_date, close, volume FROM f JOIN bars ON bars.security = n WHERE status = 'success' AND (source <> 'chart_json' OR trading_date BETWEEN DATE '{ASKED[0]}' AND DATE '{ASKED[1]}'))
, c AS (SELECT n, count(*) AS n_bars, min(trading_date) AS first_date, max(trading_date) AS last_date FROM b GROUP BY 1)"""

QUERIES = {
    "collected_manifests": (
        collected_manifests,
        ctes("bars")
        + _COLLECTED
        + """
SELECT 'N' || n AS symbol, source, own AS network_performed, CASE WHEN own THEN status WHEN status = 'success' THEN 'reprocessed' ELSE 'not_fetched' END AS status, n_bars, first_date, last_date, false AS leaks, NOT own AND status = 'success' AS has_origin
FROM f LEFT JOIN c USING (n), (SELECT true AS own UNION ALL SELECT false) o""",
    ),
    "collected_bars": (
        collected_bars,
        ctes("bars") + _COLLECTED + "\nSELECT source, trading_date, 2 * count(*) AS n, CAST(2 * sum(volume) AS BIGINT) AS volume, max(close) AS high FROM b GROUP BY 1, 2",
    ),
    "source_chart_json": (chart, _bars_sql()),
    "source_keyed_json": (keyed, _bars_sql()),
    "source_array_json": (array, _bars_sql()),
    "source_csv": (csv, _bars_sql()),
    "source_directory": (directory, "SELECT CAST(s_nationkey AS VARCHAR) AS request_id, 'S' || s_suppkey AS symbol, s_name AS security_name, 'N' AS test_issue FROM supplier"),
    "http_categories": (
        categories,
        "SELECT ['success', 'authentication', 'entitlement', 'not_found', 'rate_limited', 'provider_error', 'request_error', 'request_error'][o_orderkey % 8 + 1] AS category, count(*) AS n FROM orders GROUP BY 1",
    ),
    "strict_values": (strict_values, "SELECT count(*) FILTER (o_orderkey % 6 IN (0, 2)) AS n_instants, count(*) FILTER (o_orderkey % 6 = 0) AS n_days, count(*) FILTER (o_orderkey % 6 IN (0, 3, 5)) AS n_numbers, count(*) FILTER (o_orderkey % 6 = 5) AS n_integers FROM orders"),
    "price_fan_out": (
        fan_out,
        ctes("bars") + "\nSELECT 'ohlcv' AS price_kind, count(*) AS n, count(open) AS n_open, round(sum(close), 4) AS sum_close FROM bars UNION ALL SELECT 'close_only', count(*), 0, round(sum(close * 0.9), 4) FROM bars WHERE volume % 3 = 0",
    ),
    "security_identity": (
        securities,
        """
WITH c AS (SELECT c_custkey, c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 AS v FROM customer)
SELECT CASE WHEN v THEN 'verified' ELSE 'temporary' END AS identifier_verification, count(*) AS n, count(DISTINCT CASE WHEN v THEN c_custkey // 2 ELSE c_custkey END) AS n_securities FROM c GROUP BY 1""",
    ),
    "matching_origins": (
        origins,
        """
WITH o AS (SELECT o_orderkey % 4000 AS q, o_orderkey % 3 AS w, o_orderkey AS r FROM orders), k AS (SELECT q, w, count(DISTINCT r) AS n FROM o WHERE r % 7 <> 0 GROUP BY 1, 2)
SELECT CASE WHEN n IS NULL THEN 'original_receipt_missing' WHEN n > 1 THEN 'original_receipt_ambiguous' ELSE 'matched' END AS issue, count(*) AS n FROM o LEFT JOIN k USING (q, w) GROUP BY 1""",
    ),
    "action_issues": (
        action_faults,
        ctes("dated_actions")
        + """
, a AS (SELECT event_type, CASE WHEN amount < 0.05 THEN -1 ELSE amount END AS amount, count(*) OVER (PARTITION BY security, event_type, ex_date) AS k FROM dated_actions)
SELECT issue, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN k > 1 THEN 'duplicate_event_key' END, CASE WHEN event_type = 'dividend' AND amount < 0 THEN 'dividend_amount_invalid' END], lambda x: x IS NOT NULL)) AS issue FROM a) GROUP BY 1""",
    ),
    "stream_append_once": (appended_once, "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1"),
    "cached_responses": (
        cached,
        ctes("receipts") + "\n, t AS (SELECT request_id, received_at + INTERVAL '1' SECOND * (CAST(substr(receipt_id, 2) AS BIGINT) % 1000) AS recorded_at, status FROM receipts WHERE status = 'success')\nSELECT request_id, max(recorded_at) AS recorded_at, 'success' AS status FROM t GROUP BY 1",
    ),
}
