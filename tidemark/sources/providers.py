"""Provider responses that landed as files or rows, normalised to bars and actions.

Each normaliser takes rows of (request_id, body) and gives rows with ``issue`` set where a response
or a value cannot be used; nothing raises on data. Fetching is not part of this: a collector drops
responses into a landing folder and these read it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.values import DAY, day, finite, first_reason, number

BAR = "request_id string, trading_date date, open double, high double, low double, close double, adjusted_close double, volume bigint, price_semantics string, observation_status string, issue string"
CHART = (
    "chart struct<error:struct<code:string,description:string>,result:array<struct<meta:struct<currency:string,exchangeTimezoneName:string>,timestamp:array<bigint>,"
    "indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<bigint>>>,adjclose:array<struct<adjclose:array<double>>>>,"
    "events:struct<splits:map<string,struct<date:bigint,numerator:double,denominator:double>>,dividends:map<string,struct<date:bigint,amount:double>>>>>>"
)
SERIES = "`Meta Data` map<string,string>, `Time Series (Daily)` map<string,map<string,string>>, Note string, Information string, `Error Message` string"
#: HTTP statuses to categories.
CATEGORIES = {401: "authentication", 403: "entitlement", 404: "not_found", 429: "rate_limited"}
#: Bodies of these beginnings are a page for people, not data.
CHALLENGE = r"(?is)^\s*(<!doctype html|<html)"


def http_category(status: Column) -> Column:
    out = F.when(status.between(200, 299), "success")
    for code, name in CATEGORIES.items():
        out = out.when(status == code, name)
    return out.when(status >= 500, "provider_error").when(status.isNull(), "transport_error").otherwise("request_error")


def observation_status(close: Column, volume: Column) -> Column:
    return F.when(close.isNull(), "missing_price").when(volume.isNull(), "volume_missing").when(volume == 0, "reported_zero_volume").otherwise("observed")


def _bars(df: DataFrame, semantics: str, issue: Column) -> DataFrame:
    values = [F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "adjusted_close")]
    return df.select("request_id", "trading_date", *values, F.col("volume").cast("bigint").alias("volume"), F.lit(semantics).alias("price_semantics"), observation_status(F.col("close"), F.col("volume")).alias("observation_status"), issue.alias("issue"))


def _not_finite(*names: str) -> Column:
    """An issue where a number that is there is none, such as the NaN that raw JSON may hold."""
    return F.when(F.exists(F.array(*[F.col(n).cast("double") for n in names]), lambda x: x.isNotNull() & ~finite(x)), "invalid_number")


def _faulty(df: DataFrame, issue: Column) -> DataFrame:
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("trading_date", "date"), ("open", "double"), ("high", "double"), ("low", "double"), ("close", "double"), ("adjusted_close", "double"), ("volume", "bigint"), ("price_semantics", "string"), ("observation_status", "string"))]
    return df.select("request_id", *nothing, issue.alias("issue"))


def chart_json(df: DataFrame) -> DataFrame:
    """Parallel arrays by timestamp; arrays of unlike lengths are a change of schema."""
    parsed = df.withColumn("j", F.from_json("body", CHART))
    r = F.get("j.chart.result", 0)
    flat = parsed.select("request_id", F.col("j.chart.error").alias("error"), r.alias("r")).select("request_id", "error", "r", F.get("r.indicators.quote", 0).alias("q"), F.get("r.indicators.adjclose", 0)["adjclose"].alias("adj"))
    n = F.size("r.timestamp")
    uneven = F.exists(F.array(*[F.size(f"q.{c}") for c in ("open", "high", "low", "close", "volume")]), lambda s: s != n) | (F.col("adj").isNotNull() & (F.size("adj") != n))
    issue = first_reason((F.lower("error.code").contains("not found"), "not_found"), (F.col("error").isNotNull(), "provider_error"), (F.col("r").isNull() | F.col("q").isNull() | F.col("r.timestamp").isNull(), "schema_change"), (uneven, "schema_change"))
    judged = flat.withColumn("fault", issue)
    rows = judged.where("fault is null").select("request_id", F.col("r.meta.exchangeTimezoneName").alias("zone"), F.inline(F.arrays_zip(F.col("r.timestamp").alias("at"), F.col("q.open").alias("open"), F.col("q.high").alias("high"), F.col("q.low").alias("low"), F.col("q.close").alias("close"), F.col("q.volume").alias("volume"), F.coalesce("adj", F.array_repeat(F.lit(None).cast("double"), n)).alias("adjusted_close"))))
    dated = rows.withColumn("trading_date", F.to_date(F.from_utc_timestamp(F.timestamp_seconds("at"), F.coalesce("zone", F.lit("UTC")))))
    return _bars(dated, "split_adjusted", _not_finite("open", "high", "low", "close", "adjusted_close")).unionByName(_faulty(judged.where("fault is not null"), F.col("fault")))


def chart_actions(df: DataFrame) -> DataFrame:
    """Splits and dividends of chart responses: request_id, event_type, event_date, numerator, denominator, amount."""
    r = F.get(F.from_json("body", CHART)["chart"]["result"], 0)
    parsed = df.select("request_id", r.alias("r"))
    zone = F.coalesce(F.col("r.meta.exchangeTimezoneName"), F.lit("UTC"))
    date = lambda e: F.to_date(F.from_utc_timestamp(F.timestamp_seconds(e["date"]), zone))
    none = F.lit(None).cast("double")
    splits = F.transform(F.map_values("r.events.splits"), lambda e: F.struct(F.lit("split").alias("event_type"), date(e).alias("event_date"), e["numerator"].alias("numerator"), e["denominator"].alias("denominator"), none.alias("amount")))
    cash = F.transform(F.map_values("r.events.dividends"), lambda e: F.struct(F.lit("dividend").alias("event_type"), date(e).alias("event_date"), none.alias("numerator"), none.alias("denominator"), e["amount"].alias("amount")))
    empty = F.array().cast("array<struct<event_type:string,event_date:date,numerator:double,denominator:double,amount:double>>")
    return parsed.select("request_id", F.inline(F.concat(F.coalesce(splits, empty), F.coalesce(cash, empty))))


def keyed_json(df: DataFrame) -> DataFrame:
    """A map from date to named texts; messages tell limits, keys and entitlements apart."""
    parsed = df.withColumn("j", F.from_json("body", SERIES)).withColumn("message", F.lower(F.coalesce("j.Note", "j.Information", F.col("j.`Error Message`"))))
    days = F.col("j.`Time Series (Daily)`")
    fault = first_reason(
        (F.contains("message", F.lit("premium")), "entitlement"),
        (F.contains("message", F.lit("rate limit")) | F.contains("message", F.lit("requests per day")) | F.contains("message", F.lit("frequency")), "rate_limited"),
        (F.contains("message", F.lit("api key")) | F.contains("message", F.lit("apikey")), "authentication"),
        (F.col("message").isNotNull(), "provider_error"),
        (days.isNull(), "schema_change"),
    )
    judged = parsed.withColumn("fault", fault).withColumn("days", days)
    rows = judged.where("fault is null").select("request_id", F.explode("days").alias("date_text", "v"))
    text = {"open": "1. open", "high": "2. high", "low": "3. low", "close": "4. close", "volume": "5. volume"}
    typed = rows.withColumns({c: number(F.col("v")[k], integer=c == "volume") for c, k in text.items()}).withColumns({"trading_date": day(F.col("date_text")), "adjusted_close": F.lit(None).cast("double")})
    issue = first_reason((F.col("trading_date").isNull(), "invalid_date"), *[(F.col(c).isNull() & F.col("v")[k].isNotNull(), "invalid_number") for c, k in text.items()])
    return _bars(typed, "as_traded", issue).unionByName(_faulty(judged.where("fault is not null"), F.col("fault")))


def array_json(df: DataFrame, start: str, end: str) -> DataFrame:
    """An array of daily objects; a date outside the asked period rejects the whole response."""
    parsed = df.withColumn("rows", F.from_json("body", "array<struct<date:string,open:double,high:double,low:double,close:double,adjusted_close:double,volume:bigint>>"))
    # canonical dates order as text
    outside = F.exists("rows", lambda x: ~F.coalesce(F.rlike(x["date"], F.lit(DAY)) & x["date"].between(start, end), F.lit(False)))
    judged = parsed.withColumn("fault", first_reason((F.col("rows").isNull(), "schema_change"), (outside, "outside_requested_period")))
    rows = judged.where("fault is null").select("request_id", F.inline("rows")).withColumn("trading_date", F.col("date").cast("date"))
    return _bars(rows, "as_traded", _not_finite("open", "high", "low", "close", "adjusted_close")).unionByName(_faulty(judged.where("fault is not null"), F.col("fault")))


def ratio(text: Column) -> tuple[Column, Column]:
    """Numerator and denominator of a text such as 2/1; null if it is none."""
    parts = F.split(text, "/")
    fits = F.size(parts) == 2
    return F.when(fits, number(F.get(parts, 0))), F.when(fits, number(F.get(parts, 1)))


def array_actions(df: DataFrame, kind: str, start: str, end: str) -> DataFrame:
    """Dividends (date, value) or splits (date, split as 2/1) of array responses, as chart_actions gives them, with
    issue; a date outside the asked period rejects the whole response."""
    if kind not in ("dividend", "split"):
        raise ValueError("kind has to be dividend or split")
    parsed = df.withColumn("rows", F.from_json("body", "array<struct<date:string,value:string,split:string>>"))
    outside = F.exists("rows", lambda x: ~F.coalesce(F.rlike(x["date"], F.lit(DAY)) & x["date"].between(start, end), F.lit(False)))
    judged = parsed.withColumn("fault", first_reason((F.col("rows").isNull(), "schema_change"), (outside, "response_outside_requested_period")))
    up, down = ratio(F.col("split"))
    none = F.lit(None).cast("double")
    good = judged.where("fault is null").select("request_id", F.inline("rows")).select("request_id", F.lit(kind).alias("event_type"), F.col("date").cast("date").alias("event_date"), (up if kind == "split" else none).alias("numerator"), (down if kind == "split" else none).alias("denominator"), (number(F.col("value")) if kind == "dividend" else none).alias("amount"))
    value = F.col("amount") if kind == "dividend" else F.col("numerator") / F.col("denominator")
    good = good.withColumn("issue", F.when(~finite(value), "invalid_number"))
    bad = judged.where("fault is not null").select("request_id", F.lit(kind).alias("event_type"), F.lit(None).cast("date").alias("event_date"), *[none.alias(n) for n in ("numerator", "denominator", "amount")], F.col("fault").alias("issue"))
    return good.unionByName(bad)


def array_identity(df: DataFrame) -> DataFrame:
    """Identities of listed securities: request_id, code, name, isin, currency, and issue where code or isin is missing."""
    rows = df.select("request_id", F.explode_outer(F.from_json("body", "array<struct<Code:string,Name:string,Isin:string,Currency:string>>")).alias("x"))
    issue = first_reason((F.col("x").isNull() | F.col("x.Code").isNull(), "schema_change"), (F.col("x.Isin").isNull() | (F.col("x.Isin") == ""), "identity_incomplete"))
    return rows.select("request_id", F.col("x.Code").alias("code"), F.col("x.Name").alias("name"), F.nullif(F.col("x.Isin"), F.lit("")).alias("isin"), F.col("x.Currency").alias("currency"), issue.alias("issue"))


def within_period(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Bars of the asked period, both ends included; faulty responses stay, with their issue."""
    return bars.where(F.col("issue").isNotNull() | F.col("trading_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def csv_text(df: DataFrame) -> DataFrame:
    """A CSV body with a header line; a page for people is a challenge, `No data` is empty."""
    body = F.trim("body")
    judged = df.withColumn("fault", first_reason((F.rlike(F.col("body"), F.lit(CHALLENGE)), "html_challenge"), (~F.startswith(body, F.lit("Date,")) & (body != "No data"), "schema_change")))
    lines = judged.where("fault is null").select("request_id", F.explode(F.split(body, "\r?\n")).alias("line")).where("line <> '' and line <> 'No data' and not startswith(line, 'Date,')")
    v = F.split("line", ",")
    names = ("open", "high", "low", "close", "volume")
    typed = lines.withColumns({c: number(F.get(v, k + 1), integer=c == "volume") for k, c in enumerate(names)}).withColumns({"trading_date": day(F.get(v, 0)), "adjusted_close": F.lit(None).cast("double")})
    issue = first_reason((F.col("trading_date").isNull(), "invalid_date"), (F.col("close").isNull(), "invalid_number"))
    return _bars(typed, "unknown", issue).unionByName(_faulty(judged.where("fault is not null"), F.col("fault")))


def directory_text(df: DataFrame) -> DataFrame:
    """A pipe-delimited symbol directory: request_id, symbol, security_name, test_issue; its trailer line goes."""
    lines = df.select("request_id", F.posexplode(F.split("body", "\r?\n")).alias("n", "line")).where("n > 0 and line <> '' and not startswith(line, 'File Creation Time')")
    v = F.split("line", r"\|")
    return lines.select("request_id", F.get(v, 0).alias("symbol"), F.get(v, 1).alias("security_name"), F.get(v, 3).alias("test_issue"))


def document_receipt(df: DataFrame, hosts: tuple[str, ...]) -> DataFrame:
    """Evidence documents: url, host, allowed, sha256 and size; the content itself is not read."""
    host = F.parse_url("url", F.lit("HOST"))
    https = F.parse_url("url", F.lit("PROTOCOL")) == "https"
    return df.select("request_id", "url", host.alias("host"), F.coalesce(https & host.isin(*hosts), F.lit(False)).alias("allowed"), F.sha2(F.col("body").cast("binary"), 256).alias("sha256"), F.octet_length("body").alias("size"))


PROVIDERS: dict[str, Callable[[DataFrame], DataFrame]] = {"chart_json": chart_json, "keyed_json": keyed_json, "csv": csv_text, "directory": directory_text}
#: Those that need the asked period or the allowed hosts as well.
PARAMETERISED: dict[str, Callable[..., DataFrame]] = {"array_json": array_json, "array_actions": array_actions, "document": document_receipt}


def normaliser(name: str) -> Callable[[DataFrame], DataFrame]:
    known = PROVIDERS | PARAMETERISED
    if name not in known:
        raise ValueError(f"provider has to be one of {sorted(known)}")
    return known[name]


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw responses as bytes with their digest: path, size, sha256, body."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.decode("content", "utf-8").alias("body"))


def verified_raw(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Manifests with raw_issue: their raw file is missing, of another size, or of another content."""
    now = files.select(F.col("path").alias("raw_path"), F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
    out = manifests.join(now, "raw_path", "left")
    reason = first_reason((F.col("_sha").isNull(), "raw_file_missing"), (F.col("_size") != F.col("file_size"), "raw_size_mismatch"), (F.col("_sha") != F.col("sha256"), "raw_hash_mismatch"))
    return out.withColumn("raw_issue", reason).drop("_size", "_sha")
