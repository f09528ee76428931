"""Calendar, bar, feature and label queries over weekly series, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as quality
from tidemark.operators import calendar, diagnostics, features, labels
from tidemark.plans.roles import ctes, role

SERIES = ["security"]
EVALUATION, SIMULATION = "1998-03-02 00:00:00", "1998-06-01 00:00:00"


def rounded(df: DataFrame, keys: list[str], names: list[str], digits: int = 9) -> DataFrame:
    return df.select(*keys, *[F.round(n, digits).alias(n) for n in names])


def all_bars(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "bars")


def plan(spark: SparkSession, sf: str) -> DataFrame:
    return calendar.plan(role(spark, sf, "sessions"))


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    return calendar.gaps(role(spark, sf, "bars"), role(spark, sf, "sessions"), SERIES)


def issues(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with faults put in by rule."""
    k = F.pmod(F.datediff("trading_date", F.lit("1992-01-06").cast("date")) / 7 + F.col("security"), F.lit(20))
    bad = role(spark, sf, "bars").withColumns(
        {
            "close": F.when(k == 1, None).when(k == 2, F.col("high") * 2).when(k == 3, -F.col("close")).when(k == 4, 0.0).otherwise(F.col("close")),
            "volume": F.when(k == 5, None).when(k == 6, -F.col("volume")).when(k == 7, 0).otherwise(F.col("volume")),
        }
    )
    return bad.select("security", F.explode(quality.issue_codes()).alias("code")).groupBy("security", "code").agg(F.count("*").alias("n"))


def duplicate_bars(spark: SparkSession, sf: str) -> DataFrame:
    ticks = role(spark, sf, "ticks").withColumn("price", F.floor("price"))
    return quality.duplicates(ticks, ["security", "trading_date"], ["place"], ["price"]).groupBy("security", "code").agg(F.count("*").alias("n"))


def moves(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.large_moves(role(spark, sf, "bars"), role(spark, sf, "sessions"), SERIES)
    return out.select("security", "trading_date", "previous_date", F.round("change", 9).alias("change"))


def two_sources(spark: SparkSession, sf: str) -> DataFrame:
    bars = role(spark, sf, "sourced_bars")
    left, right = (bars.where(F.col("source") == n).drop("source") for n in ("alpha", "beta"))
    return quality.compare_sources(left, right, ["security", "trading_date"]).select("security", "trading_date", "field", F.round("relative_difference", 9).alias("relative_difference"))


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    missing = gaps(spark, sf)
    return missing.groupBy("security").agg(F.count("*").alias("n_missing"), F.min("trading_date").alias("first_missing"), F.max("trading_date").alias("last_missing"))


def adjusted_actions(spark: SparkSession, sf: str) -> DataFrame:
    bars = role(spark, sf, "bars").withColumn("adjusted_close", F.col("close") * (1 - F.col("security") / 1000))
    actions = role(spark, sf, "dated_actions").withColumnRenamed("ex_date", "event_date")
    return quality.action_checks(bars, actions, SERIES).groupBy("security", "event_type", "status").agg(F.count("*").alias("n"))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return features.features(calendar.spine(role(spark, sf, "bars"), role(spark, sf, "sessions"), SERIES), SERIES)


def feature_query(*names: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(_features(spark, sf), ["security", "trading_date"], list(names))

    return run


def feature_reasons(spark: SparkSession, sf: str) -> DataFrame:
    names = ["close_price_change_1", "close_price_change_20", "open_gap", "volume_to_prior20_mean"]
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.coalesce(f"{n}_reason", F.lit("ready")).alias("reason")) for n in names])
    return _features(spark, sf).select(F.inline(pairs)).groupBy("feature", "reason").agg(F.count("*").alias("n"))


def elapsed(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).groupBy("security").agg(F.max("elapsed_sessions").alias("longest_wait"), F.count_if("missing_any").alias("n_missing_any"))


def _endpoints(spark: SparkSession, sf: str) -> DataFrame:
    bars = role(spark, sf, "bars")
    samples = bars.select("security", F.col("trading_date").alias("decision_date"))
    return labels.endpoints(samples, calendar.plan(role(spark, sf, "sessions")), bars, SERIES)


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    actions = role(spark, sf, "dated_actions").withColumn("payment_date", F.date_add("ex_date", 14))
    out = labels.ledger(_endpoints(spark, sf), actions, SERIES, ["security", "decision_date", "horizon"])
    out = out.withColumns(labels.flags(F.col("price_return"), F.col("horizon")))
    return out.where("price_return is not null").select("security", "decision_date", "horizon", "n_actions", *[F.round(c, 6).alias(c) for c in ("price_return", "cash_return")])


def five_session_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = _endpoints(spark, sf).where("horizon = 5").withColumn("price_return", F.try_divide("exit_open", "entry_open") - 1)
    return rows.where("price_return is not null").withColumns(labels.flags(F.col("price_return"), F.col("horizon"))).groupBy("security").agg(F.count_if("up_5").alias("n_up"), F.count_if("down_5pct_5").alias("n_down"), F.count("*").alias("n"))


def statuses(spark: SparkSession, sf: str) -> DataFrame:
    clock = [F.lit(x).cast("timestamp_ntz") for x in (EVALUATION, SIMULATION)]
    guards = labels.clock_guards(*clock, delay_hours=48) | {"delisted": (F.col("security") == 7) & (F.col("exit_date") >= F.lit("1997-01-01").cast("date")), "prelisting": (F.col("security") == 8) & (F.col("entry_date") < F.lit("1993-01-01").cast("date"))}
    return labels.with_status(_endpoints(spark, sf), guards).groupBy("horizon", "status", "reason").agg(F.count("*").alias("n"))


def rule_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions over all days between the first and the last order; days with certain numbers of orders are holidays or close early."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("trading_date"))
    days = orders.agg(F.min("trading_date").alias("a"), F.max("trading_date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("trading_date"))
    counts = orders.groupBy("trading_date").agg(F.count("*").alias("n"))
    early = counts.where("n % 7 = 3").select("trading_date", F.lit("13:00").alias("closes"))
    return calendar.sessions_by_rule(days, counts.where("n % 5 = 1"), early, version="rule-1")


def blockers(spark: SparkSession, sf: str) -> DataFrame:
    clock = [F.lit(x).cast("timestamp_ntz") for x in (EVALUATION, SIMULATION)]
    rows = labels.with_status(_endpoints(spark, sf), labels.clock_guards(*clock, delay_hours=48))
    return diagnostics.blockers(rows, ["security", "decision_date"])


def reassessed(spark: SparkSession, sf: str) -> DataFrame:
    clock = [F.lit(x).cast("timestamp_ntz") for x in (EVALUATION, SIMULATION)]
    rows = labels.with_status(_endpoints(spark, sf), labels.clock_guards(*clock, delay_hours=48))
    later = diagnostics.reassessed(rows, F.lit("1998-05-01 00:00:00").cast("timestamp_ntz"))
    return later.groupBy("status", "later_status").agg(F.count("*").alias("n"))


def forward_gates(spark: SparkSession, sf: str) -> DataFrame:
    rows = calendar.plan(role(spark, sf, "sessions")).withColumn("reason", diagnostics.forward_timing(F.lit("1996-05-06 23:00:00").cast("timestamp_ntz")))
    return rows.groupBy(F.coalesce("reason", F.lit("open")).alias("reason")).agg(F.count("*").alias("n"))


_BARS, _CAL = ctes("bars"), ctes("bars", "sessions")
_SPINE = (
    _CAL
    + """
, last AS (SELECT b.security, max(s.idx) AS top FROM bars b JOIN sessions s USING (trading_date) GROUP BY 1
), dense AS (
  SELECT l.security, s.idx, s.trading_date, b.open, b.high, b.low, b.close, b.volume, b.security IS NOT NULL AS observed
  FROM last l JOIN sessions s ON s.idx <= l.top LEFT JOIN bars b ON b.security = l.security AND b.trading_date = s.trading_date
), logs AS (SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY security ORDER BY idx) AS step FROM dense
), f AS (
  SELECT *, """
    + ",\n".join(f"count(*) FILTER (observed) OVER (PARTITION BY security ORDER BY idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in (2, 6, 20, 21, 60, 61))
    + """,
    min(idx) FILTER (observed) OVER (PARTITION BY security ORDER BY idx ROWS BETWEEN 60 PRECEDING AND CURRENT ROW) AS earliest,
    lag(observed) OVER w AS before, lag(close, 1) OVER w AS k1, lag(close, 5) OVER w AS k5, lag(close, 20) OVER w AS k20, lag(close, 60) OVER w AS k60,
    stddev_samp(step) OVER (PARTITION BY security ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s5,
    stddev_samp(step) OVER (PARTITION BY security ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s20,
    stddev_samp(step) OVER (PARTITION BY security ORDER BY idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS s60,
    avg(close) OVER (PARTITION BY security ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m20,
    avg(close) OVER (PARTITION BY security ORDER BY idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS m60,
    avg(volume) OVER (PARTITION BY security ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS v20,
    idx - max(CASE WHEN observed THEN idx END) OVER (PARTITION BY security ORDER BY idx) AS waited
  FROM logs WINDOW w AS (PARTITION BY security ORDER BY idx)
)"""
)


def _why(n: int) -> str:
    return f"""CASE WHEN idx + 1 < {n} THEN 'lookback_outside_calendar' WHEN c{n} < {n} AND c{n} > 0 AND c{n} = idx - greatest(earliest, idx - {n} + 1) + 1 THEN 'insufficient_history_or_prelisting_unverified'
 WHEN c{n} < {n} THEN 'missing_session_or_collection_failure' ELSE 'ready' END"""


_MISSING = "NOT observed OR c2 < 2 OR c6 < 6 OR c21 < 21 OR c61 < 61 OR c20 < 20 OR c60 < 60"
_ENDS = (
    _CAL
    + """
, plan AS (
  SELECT trading_date AS decision_date, close_utc + INTERVAL '1' HOUR AS decision_at, lead(trading_date, 1) OVER w AS entry_date, lead(open_utc, 1) OVER w AS entry_at,
         h AS horizon, lead(trading_date, CAST(1 + h AS INTEGER)) OVER w AS exit_date, lead(open_utc, CAST(1 + h AS INTEGER)) OVER w AS exit_at, lead(close_utc, CAST(1 + h AS INTEGER)) OVER w AS exit_close
  FROM sessions CROSS JOIN (SELECT unnest([1, 5, 20]) AS h) t WINDOW w AS (PARTITION BY h ORDER BY idx)
), ends AS (
  SELECT b.security, p.*, e.open AS entry_open, x.open AS exit_open
  FROM bars b JOIN plan p ON p.decision_date = b.trading_date LEFT JOIN bars e ON e.security = b.security AND e.trading_date = p.entry_date
  LEFT JOIN bars x ON x.security = b.security AND x.trading_date = p.exit_date
)"""
)
_K = "((CAST(date_diff('day', DATE '1992-01-06', trading_date) AS BIGINT) // 7 + security) % 20 + 20) % 20"

QUERIES = {
    "bars_from_ticks": (all_bars, _BARS + "\nSELECT * FROM bars"),
    "calendar_plan": (
        plan,
        _CAL
        + "\nSELECT trading_date AS decision_date, idx, close_utc + INTERVAL '1' HOUR AS decision_at, lead(trading_date, 1) OVER w AS entry_date, lead(open_utc, 1) OVER w AS intended_entry_at, "
        + ", ".join(f"lead(trading_date, {1 + h}) OVER w AS exit_date_{h}, lead(open_utc, {1 + h}) OVER w AS exit_at_{h}, lead(close_utc, {1 + h}) OVER w AS exit_close_{h}" for h in (1, 5, 20))
        + " FROM sessions WINDOW w AS (ORDER BY idx)",
    ),
    "calendar_gaps": (
        gaps,
        _CAL
        + """
, span AS (SELECT security, min(trading_date) AS lo, max(trading_date) AS hi FROM bars GROUP BY 1)
SELECT p.security, s.trading_date FROM span p JOIN sessions s ON s.trading_date BETWEEN p.lo AND p.hi ANTI JOIN bars b ON b.security = p.security AND b.trading_date = s.trading_date""",
    ),
    "bar_validation_issues": (
        issues,
        _BARS
        + f"""
, bad AS (SELECT security, open, high, low, CASE {_K} WHEN 1 THEN NULL WHEN 2 THEN high * 2 WHEN 3 THEN -close WHEN 4 THEN 0 ELSE close END AS close,
                 CASE {_K} WHEN 5 THEN NULL WHEN 6 THEN -volume WHEN 7 THEN 0 ELSE volume END AS volume FROM bars
), found AS (SELECT security, unnest(list_filter([CASE WHEN close IS NULL THEN 'missing_price' END, CASE WHEN low > least(open, close) + 1e-6 OR high + 1e-6 < greatest(open, close) OR low > high THEN CASE WHEN close IS NOT NULL THEN 'inconsistent_ohlc' END END,
   CASE WHEN close IS NOT NULL AND least(open, high, low, close) < 0 THEN 'negative_price' END, CASE WHEN close = 0 THEN 'zero_price' END, CASE WHEN volume IS NULL THEN 'missing_volume' END,
   CASE WHEN volume < 0 THEN 'negative_volume' END, CASE WHEN volume = 0 THEN 'reported_zero_volume_not_proof_of_no_trading' END], lambda x: x IS NOT NULL)) AS code FROM bad)
SELECT security, code, count(*) AS n FROM found GROUP BY 1, 2""",
    ),
    "bar_duplicate_conflicts": (
        duplicate_bars,
        ctes("ticks")
        + """
, m AS (SELECT security, place, floor(price) = first_value(floor(price)) OVER (PARTITION BY security, trading_date ORDER BY place) AS same FROM ticks)
SELECT security, CASE WHEN same THEN 'duplicate_key' ELSE 'conflicting_duplicate' END AS code, count(*) AS n FROM m WHERE place > 1 GROUP BY 1, 2""",
    ),
    "large_move_flags": (
        moves,
        _CAL
        + """
, b AS (SELECT security, trading_date, close, idx, lag(trading_date) OVER w AS previous_date, lag(close) OVER w AS k, lag(idx) OVER w AS i FROM bars JOIN sessions USING (trading_date) WINDOW w AS (PARTITION BY security ORDER BY trading_date))
SELECT security, trading_date, previous_date, round(close / k - 1, 9) AS change FROM b WHERE idx - i = 1 AND abs(close / k - 1) > 0.25""",
    ),
    "cross_provider_tolerance": (
        two_sources,
        ctes("sourced_bars")
        + """
, p AS (SELECT a.security, a.trading_date, unnest(['open', 'high', 'low', 'close', 'volume']) AS field, unnest([a.open, a.high, a.low, a.close, a.volume]) AS x, unnest([b.open, b.high, b.low, b.close, b.volume]) AS y
        FROM sourced_bars a JOIN sourced_bars b ON a.security = b.security AND a.trading_date = b.trading_date WHERE a.source = 'alpha' AND b.source = 'beta')
SELECT security, trading_date, field, round(abs(x - y) / abs(x), 9) AS relative_difference FROM p WHERE abs(x - y) / abs(x) > CASE WHEN field = 'volume' THEN 1e-4 ELSE 1e-5 END""",
    ),
    "session_coverage": (
        coverage,
        _CAL
        + """
, span AS (SELECT security, min(trading_date) AS lo, max(trading_date) AS hi FROM bars GROUP BY 1
), gone AS (SELECT p.security, s.trading_date FROM span p JOIN sessions s ON s.trading_date BETWEEN p.lo AND p.hi ANTI JOIN bars b ON b.security = p.security AND b.trading_date = s.trading_date)
SELECT security, count(*) AS n_missing, min(trading_date) AS first_missing, max(trading_date) AS last_missing FROM gone GROUP BY 1""",
    ),
    "action_adjustment_checks": (
        adjusted_actions,
        ctes("bars", "dated_actions")
        + """
, b AS (SELECT *, close * (1 - security / 1000) AS adjusted FROM bars
), j AS (SELECT a.security, a.event_type, a.numerator, a.denominator, a.amount, p.close AS pc, p.adjusted AS pa, x.close AS xc, x.adjusted AS xa
         FROM dated_actions a ASOF LEFT JOIN b p ON a.security = p.security AND a.ex_date > p.trading_date LEFT JOIN b x ON x.security = a.security AND x.trading_date = a.ex_date
), s AS (SELECT security, event_type, CASE WHEN pc IS NULL OR xc IS NULL THEN 'skipped' WHEN event_type = 'split' THEN 'observed'
         WHEN abs((pa / pc) / (xa / xc) - (1 - amount / pc)) < 5e-5 THEN 'passed' ELSE 'review' END AS status FROM j)
SELECT security, event_type, status, count(*) AS n FROM s GROUP BY 1, 2, 3""",
    ),
    "feature_returns": (
        feature_query(*[f"close_price_change_{n}" for n in (1, 5, 20, 60)]),
        _SPINE + "\nSELECT security, trading_date, " + ", ".join(f"CASE WHEN c{n + 1} = {n + 1} THEN round(close / k{n} - 1, 9) END AS close_price_change_{n}" for n in (1, 5, 20, 60)).replace("c61 = 61", "c61 = 61") + " FROM f",
    ),
    "feature_volatility": (
        feature_query(*[f"realized_log_price_change_volatility_{n}" for n in (5, 20, 60)]),
        _SPINE + "\nSELECT security, trading_date, " + ", ".join(f"CASE WHEN c{n + 1} = {n + 1} THEN round(s{n}, 9) END AS realized_log_price_change_volatility_{n}" for n in (5, 20, 60)) + " FROM f",
    ),
    "feature_ma_ratio": (
        feature_query("close_to_ma_20", "close_to_ma_60"),
        _SPINE + "\nSELECT security, trading_date, CASE WHEN c20 = 20 THEN round(close / m20 - 1, 9) END AS close_to_ma_20, CASE WHEN c60 = 60 THEN round(close / m60 - 1, 9) END AS close_to_ma_60 FROM f",
    ),
    "feature_gap_range_relvol": (
        feature_query("open_gap", "intraday_high_low_ratio", "volume_to_prior20_mean"),
        _SPINE
        + "\nSELECT security, trading_date, CASE WHEN c2 = 2 THEN round(open / k1 - 1, 9) END AS open_gap, round(high / low - 1, 9) AS intraday_high_low_ratio, CASE WHEN c21 = 21 THEN round(volume / v20, 9) END AS volume_to_prior20_mean FROM f",
    ),
    "feature_status_reasons": (
        feature_reasons,
        _SPINE
        + f"""
, r AS (SELECT unnest(['close_price_change_1', 'close_price_change_20', 'open_gap', 'volume_to_prior20_mean']) AS feature, unnest([{_why(2)}, {_why(21)}, {_why(2)}, {_why(21)}]) AS reason FROM f)
SELECT feature, reason, count(*) AS n FROM r GROUP BY 1, 2""",
    ),
    "feature_elapsed_missing": (elapsed, _SPINE + f"\nSELECT security, max(waited) AS longest_wait, count(*) FILTER ({_MISSING}) AS n_missing_any FROM f GROUP BY 1"),
    "label_returns": (
        outcomes,
        _ENDS.replace("WITH ", ctes("dated_actions") + ", ", 1)
        + """
, own AS (
  SELECT e.security, e.decision_date, e.horizon, a.event_type, a.amount, a.ex_date, e.exit_date,
         exp(sum(ln(CASE WHEN a.event_type = 'split' THEN CAST(numerator AS DOUBLE) / denominator ELSE 1 END)) OVER (PARTITION BY e.security, e.decision_date, e.horizon
             ORDER BY a.ex_date, CASE WHEN a.event_type = 'split' THEN 0 ELSE 1 END, a.version_id)) AS q
  FROM ends e JOIN dated_actions a ON a.security = e.security AND e.entry_date < a.ex_date AND a.ex_date <= e.exit_date
), t AS (SELECT security, decision_date, horizon, count(*) AS n_actions, arg_max(q, ex_date) AS any_q, sum(CASE WHEN event_type = 'dividend' THEN q * amount ELSE 0 END) AS cash FROM own GROUP BY 1, 2, 3
), z AS (SELECT e.security, e.decision_date, e.horizon, exp(sum(ln(CAST(numerator AS DOUBLE) / denominator))) AS q FROM ends e JOIN dated_actions a ON a.event_type = 'split' AND a.security = e.security AND e.entry_date < a.ex_date AND a.ex_date <= e.exit_date GROUP BY 1, 2, 3)
SELECT e.security, e.decision_date, CAST(e.horizon AS INTEGER) AS horizon, CAST(coalesce(n_actions, 0) AS INTEGER) AS n_actions, round(coalesce(z.q, 1) * exit_open / entry_open - 1, 6) AS price_return,
       round((coalesce(z.q, 1) * exit_open + coalesce(cash, 0)) / entry_open - 1, 6) AS cash_return
FROM ends e LEFT JOIN t ON t.security = e.security AND t.decision_date = e.decision_date AND t.horizon = e.horizon LEFT JOIN z ON z.security = e.security AND z.decision_date = e.decision_date AND z.horizon = e.horizon
WHERE exit_open / entry_open IS NOT NULL""",
    ),
    "label_up_down_flags": (
        five_session_flags,
        _ENDS + "\nSELECT security, count(*) FILTER (exit_open / entry_open - 1 > 0) AS n_up, count(*) FILTER (exit_open / entry_open - 1 <= -0.05) AS n_down, count(*) AS n FROM ends WHERE horizon = 5 AND exit_open / entry_open IS NOT NULL GROUP BY 1",
    ),
    "label_status": (
        statuses,
        _ENDS
        + f"""
, s AS (SELECT horizon, CASE WHEN exit_at IS NULL OR entry_at IS NULL THEN 'blocked:calendar_horizon_outside_provided_range' WHEN exit_at > TIMESTAMP '{SIMULATION}' THEN 'pending:target_open_not_yet_reached'
   WHEN exit_at > TIMESTAMP '{EVALUATION}' THEN 'pending:target_open_after_label_evaluation_asof' WHEN security = 7 AND exit_date >= DATE '1997-01-01' THEN 'blocked:delisting_outcome_missing_or_unsupported'
   WHEN security = 8 AND entry_date < DATE '1993-01-01' THEN 'blocked:security_prelisting_or_listing_unknown'
   WHEN (entry_open IS NULL OR exit_open IS NULL) AND TIMESTAMP '{EVALUATION}' <= exit_close + INTERVAL '48' HOUR THEN 'pending:waiting_for_received_usable_open_price_within_delay'
   WHEN entry_open IS NULL OR exit_open IS NULL THEN 'blocked:past_endpoint_price_missing_or_collection_failure' ELSE 'ready' END AS v FROM ends)
SELECT CAST(horizon AS INTEGER) AS horizon, split_part(v, ':', 1) AS status, nullif(split_part(v, ':', 2), '') AS reason, count(*) AS n FROM s GROUP BY 1, 2, 3""",
    ),
    "calendar_rows": (
        rule_sessions,
        """
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT min(d)::TIMESTAMP AS a, max(d)::TIMESTAMP AS b FROM o),
d AS (SELECT CAST(unnest(range(a, b + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS trading_date FROM e),
c AS (SELECT trading_date, CASE WHEN n % 7 = 3 THEN INTERVAL 13 HOUR ELSE INTERVAL 16 HOUR END AS late FROM d LEFT JOIN o ON o.d = d.trading_date WHERE isodow(trading_date) <= 5 AND coalesce(n % 5, 0) <> 1)
SELECT 'rule-1' AS calendar_version, trading_date, ((trading_date::TIMESTAMP + INTERVAL '570' MINUTE) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS open_utc,
       ((trading_date::TIMESTAMP + late) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS close_utc, 'America/New_York' AS timezone FROM c""",
    ),
    "blocker_categories": (
        blockers,
        _ENDS
        + f"""
, s AS (SELECT security, decision_date, CASE WHEN exit_at IS NULL OR entry_at IS NULL THEN 'calendar:calendar_horizon_outside_provided_range' WHEN exit_at > TIMESTAMP '{SIMULATION}' THEN 'waiting:target_open_not_yet_reached'
   WHEN exit_at > TIMESTAMP '{EVALUATION}' THEN 'waiting:target_open_after_label_evaluation_asof'
   WHEN (entry_open IS NULL OR exit_open IS NULL) AND TIMESTAMP '{EVALUATION}' <= exit_close + INTERVAL '48' HOUR THEN 'waiting:waiting_for_received_usable_open_price_within_delay'
   WHEN entry_open IS NULL OR exit_open IS NULL THEN 'prices:past_endpoint_price_missing_or_collection_failure' END AS v FROM ends)
SELECT split_part(v, ':', 1) AS category, split_part(v, ':', 2) AS reason, count(*) AS n_rows, count(DISTINCT (security, decision_date)) AS n_samples FROM s WHERE v IS NOT NULL GROUP BY 1, 2""",
    ),
    "pending_reassessment": (
        reassessed,
        _ENDS
        + f"""
, s AS (SELECT *, CASE WHEN exit_at IS NULL OR entry_at IS NULL THEN 'blocked' WHEN exit_at > TIMESTAMP '{EVALUATION}' THEN 'pending' WHEN entry_open IS NULL OR exit_open IS NULL THEN CASE WHEN TIMESTAMP '{EVALUATION}' <= exit_close + INTERVAL '48' HOUR THEN 'pending' ELSE 'blocked' END ELSE 'ready' END AS status FROM ends)
SELECT status, CASE WHEN status <> 'pending' THEN status WHEN exit_at > TIMESTAMP '1998-05-01' OR TIMESTAMP '1998-05-01' <= exit_close + INTERVAL '48' HOUR THEN 'pending' ELSE 'blocked' END AS later_status, count(*) AS n FROM s GROUP BY 1, 2""",
    ),
    "forward_timing": (
        forward_gates,
        _CAL
        + """
, p AS (SELECT close_utc + INTERVAL '1' HOUR AS decision_at, lead(open_utc) OVER (ORDER BY idx) AS entry_at FROM sessions)
SELECT CASE WHEN entry_at IS NULL THEN 'schedule_outside_calendar' WHEN TIMESTAMP '1996-05-06 23:00:00' < decision_at THEN 'before_decision_time' WHEN TIMESTAMP '1996-05-06 23:00:00' >= entry_at THEN 'entry_already_passed' ELSE 'open' END AS reason, count(*) AS n FROM p GROUP BY 1""",
    ),
}
