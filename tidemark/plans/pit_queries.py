"""Point-in-time queries over versions and receipts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.values import assumed_available
from tidemark.operators import pit
from tidemark.plans.roles import ctes, role

CUTOFF = "1997-06-01 03:00:00"
KEY = ["source", "security", "trading_date", "session_scope", "price_semantics"]
KEYS = ", ".join(KEY)
RULE = {"timezone": "America/New_York", "delay_hours": 1}


def cutoff():
    return F.lit(CUTOFF).cast("timestamp_ntz")


def _run(spark: SparkSession, sf: str, policy: str, rule: dict | None = None, **more) -> dict[str, DataFrame]:
    return pit.pit_query(role(spark, sf, "versions"), role(spark, sf, "links"), cutoff=cutoff(), policy=policy, key=KEY, rule=rule, **more)


def _heads(found: dict[str, DataFrame]) -> DataFrame:
    return found["data"].select(*KEY, "version_id", "cents", "available_at")


def observed_head(spark: SparkSession, sf: str) -> DataFrame:
    return _heads(_run(spark, sf, "observed"))


def historical_head(spark: SparkSession, sf: str) -> DataFrame:
    return _heads(_run(spark, sf, "historical_verified"))


def assumed_head(spark: SparkSession, sf: str) -> DataFrame:
    return _heads(_run(spark, sf, "research_assumed", RULE))


def exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, "observed")["exclusions"]


def historical_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, "historical_verified", session_scope="regular")["exclusions"]


def assumed_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, "research_assumed", RULE | {"allow_observation_date": True, "bar_close_delay_seconds": 3600})["exclusions"]


def conflicts(spark: SparkSession, sf: str) -> DataFrame:
    headed = _run(spark, sf, "observed")["headed"].where("status = 'unresolved_version_conflict'")
    return headed.groupBy(*KEY).agg(F.count("*").alias("n_heads"))


def withdrawals(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, "observed")["headed"].where("status = 'known_withdrawal'").select(*KEY, "version_id")


def superseded(spark: SparkSession, sf: str) -> DataFrame:
    out = pit.superseded_ids(_run(spark, sf, "observed")["headed"], KEY)
    return out.select(*KEY, "version_id", F.array_join("equivalent_ids", ",").alias("equivalent_ids"), F.array_join("superseded_ids", ",").alias("superseded_ids"))


def disagreement(spark: SparkSession, sf: str) -> DataFrame:
    return pit.cross_provider(observed_head(spark, sf), ["security", "trading_date", "session_scope", "price_semantics"], ["cents"])


def failures(spark: SparkSession, sf: str) -> DataFrame:
    return pit.latest_failures(role(spark, sf, "receipts"), cutoff())


def stale(spark: SparkSession, sf: str) -> DataFrame:
    aged = pit.receipt_age(_run(spark, sf, "observed")["data"], cutoff())
    return aged.groupBy("source", "stale_receipt").agg(F.count("*").alias("n"), F.round(F.max("receipt_age_hours"), 6).alias("oldest_hours"))


def bounds(spark: SparkSession, sf: str) -> DataFrame:
    rows = pit.calendar_bound(role(spark, sf, "versions"), role(spark, sf, "sessions"), cutoff(), "observed", calendar_version="weekly-1")
    return rows.groupBy(F.coalesce("bound_reason", F.lit("bounded")).alias("reason")).agg(F.count("*").alias("n"))


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    rows = role(spark, sf, "versions").select("version_id", "security", "trading_date").distinct()
    out = pit.resolve_symbols(rows, role(spark, sf, "assertions"))
    return out.select("version_id", "security", "trading_date", "mapping_reason", F.when(F.col("mapping_reason").isNull(), F.array_join("symbols", ",")).alias("symbols"))


WANTED = ["SYM1", "SYM7", "SYM14", "SYM21", "SYM28", "SYM35", "SYM42", "SYM49", "SYM56", "SYM63"]


def asked_symbols(spark: SparkSession, sf: str) -> DataFrame:
    rows = role(spark, sf, "versions").select("version_id", "source", "security", "trading_date").distinct()
    return pit.asked(rows, symbols=WANTED, start="1993-01-01", assertions=role(spark, sf, "assertions")).select("version_id", "security", "trading_date", F.array_join("symbols", ",").alias("symbols"))


def _lineage(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = role(spark, sf, "versions").withColumn("source_version_at", F.coalesce("revised_at", "published_at")).where("identifier_verification = 'verified'").dropDuplicates(["version_id"])
    return rows, rows.where("record_state = 'active'")


def eligible_edges(spark: SparkSession, sf: str) -> DataFrame:
    rows, eligible = _lineage(spark, sf)
    return pit.eligible_edges(pit.version_edges(rows, ["source", "security", "trading_date"]), eligible)


def lineage_roots(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _lineage(spark, sf)
    return pit.roots(pit.eligible_lineage(rows, F.col("record_state") == "active", ["source", "security", "trading_date"]))


def assumed_clock(spark: SparkSession, sf: str) -> DataFrame:
    days = role(spark, sf, "versions").select("publication_date").where("publication_date is not null").distinct()
    return days.select("publication_date", assumed_available(F.col("publication_date"), "America/New_York", 1).cast("timestamp_ntz").alias("available_at"))


def previous(spark: SparkSession, sf: str) -> DataFrame:
    rows = role(spark, sf, "versions").withColumn("at", F.greatest("published_at", "revised_at")).where("published_at is not null and evidence_raw_sha256 <> 'other'").dropDuplicates(["version_id"])
    return pit.previous_version(rows, ["source", "security", "trading_date"], "at").select("version_id", "previous_version_id")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = role(spark, sf, "versions").withColumn("at", F.greatest("published_at", "revised_at")).where("published_at is not null and evidence_raw_sha256 <> 'other'")
    return pit.version_edges(rows, ["source", "security", "trading_date"], "at").select("earlier_id", "later_id")


_C = f"TIMESTAMP '{CUTOFF}'"
_LINKED = f"""
, proof AS (
  SELECT artifact_id, count(*) FILTER (network_performed AND status = 'success') AS n_actual,
         count(*) FILTER (network_performed AND status = 'success' AND received_at <= {_C}) AS n_received,
         count(*) FILTER (network_performed AND status = 'success' AND received_at <= {_C} AND usable_at <= {_C}) AS n_usable,
         max(received_at) FILTER (network_performed AND status = 'success' AND received_at <= {_C} AND usable_at <= {_C}) AS c_received,
         max(usable_at) FILTER (network_performed AND status = 'success' AND received_at <= {_C} AND usable_at <= {_C}) AS c_usable,
         max(raw_sha256) AS raw, max(received_at) AS l_received
  FROM links GROUP BY artifact_id
)"""
_REASON = """CASE WHEN identifier_verification <> 'verified' THEN 'security_identity_unverified' WHEN price_semantics <> 'as_traded' THEN 'price_semantics_not_requested' {scope} END"""
_OBSERVED = (
    _LINKED
    + f"""
, judged AS (
  SELECT v.*, c_received AS order_at, greatest(c_received, c_usable) AS available_at, c_received AS received_at,
         CASE WHEN published_at IS NOT NULL AND evidence_raw_sha256 = raw THEN greatest(published_at, revised_at) END AS source_version_at,
         coalesce({_REASON.format(scope="")}, CASE WHEN coalesce(n_actual, 0) = 0 THEN 'actual_receipt_unproven' WHEN n_received = 0 THEN 'received_after_cutoff'
                  WHEN n_usable = 0 THEN 'processing_after_cutoff' END) AS reason
  FROM versions v LEFT JOIN proof p ON p.artifact_id = v.artifact_id
), o AS (
  SELECT *, CASE WHEN bool_and(source_version_at IS NOT NULL) OVER (PARTITION BY {KEYS}) THEN source_version_at ELSE order_at END AS at_time FROM judged WHERE reason IS NULL
), h AS (
  SELECT *, at_time = max(at_time) OVER (PARTITION BY {KEYS}) AS head FROM o
), k AS (
  SELECT *, min(value_hash) FILTER (head) OVER (PARTITION BY {KEYS}) <> max(value_hash) FILTER (head) OVER (PARTITION BY {KEYS}) AS torn,
         head AND received_at = max(received_at) FILTER (head) OVER (PARTITION BY {KEYS}) AS latest FROM h
), headed AS (
  SELECT *, CASE WHEN NOT head THEN 'superseded' WHEN torn THEN 'unresolved_version_conflict'
              WHEN latest AND version_id = min(version_id) FILTER (latest) OVER (PARTITION BY {KEYS}) THEN CASE WHEN record_state = 'withdrawn' THEN 'known_withdrawal' ELSE 'selected' END
              ELSE 'equivalent' END AS status FROM k
)"""
)


def _published(reason: str, available: str, scope: str = "") -> str:
    return (
        _LINKED
        + f"""
, timed AS (SELECT v.*, raw, {available} AS available_at FROM versions v LEFT JOIN proof p ON p.artifact_id = v.artifact_id
), judged AS (SELECT *, coalesce({_REASON.format(scope=scope)}, {reason}) AS reason FROM timed
), h AS (
  SELECT *, available_at = max(available_at) OVER (PARTITION BY {KEYS}) AS head FROM judged WHERE reason IS NULL
), k AS (
  SELECT *, min(value_hash) FILTER (head) OVER (PARTITION BY {KEYS}) <> max(value_hash) FILTER (head) OVER (PARTITION BY {KEYS}) AS torn FROM h
), headed AS (
  SELECT *, CASE WHEN NOT head THEN 'superseded' WHEN torn THEN 'unresolved_version_conflict'
              WHEN version_id = min(version_id) FILTER (head) OVER (PARTITION BY {KEYS}) THEN CASE WHEN record_state = 'withdrawn' THEN 'known_withdrawal' ELSE 'selected' END
              ELSE 'equivalent' END AS status FROM k
)"""
    )


_HISTORICAL_REASON = f"""CASE WHEN published_at IS NULL AND publication_date IS NOT NULL THEN 'publication_date_only' WHEN published_at IS NULL THEN 'publication_time_unknown'
 WHEN evidence_raw_sha256 IS DISTINCT FROM raw THEN 'publication_version_unproven' WHEN available_at > {_C} THEN 'publication_after_cutoff' END"""
_LOCAL = "(((publication_date + 1)::TIMESTAMP AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC') + INTERVAL '1' HOUR"
_BY_DATE = f"CASE WHEN published_at IS NULL AND publication_date IS NOT NULL THEN greatest({_LOCAL}, revised_at) ELSE greatest(published_at, revised_at) END"
_BY_RULE = f"""CASE WHEN published_at IS NULL AND publication_date IS NOT NULL THEN greatest({_LOCAL}, revised_at)
 WHEN published_at IS NULL THEN greatest(observation_end + INTERVAL '1' HOUR, revised_at) ELSE greatest(published_at, revised_at) END"""
_DATED = "published_at IS NULL AND publication_date IS NOT NULL AND publication_timezone"
_UNKNOWN = "WHEN published_at IS NULL AND publication_date IS NULL {} THEN 'publication_time_unknown_no_assumption_input'"
_ASSUMED_REASON = f"""CASE WHEN {_DATED} IS NULL THEN 'assumption_source_timezone_unknown' WHEN {_DATED} <> 'America/New_York' THEN 'assumption_timezone_mismatch'
 {{}} WHEN available_at > {_C} THEN 'assumed_publication_after_cutoff' END"""
_SELECTED_ALL = f"\nSELECT {KEYS}, version_id, cents, available_at FROM headed WHERE status = 'selected'"
_COUNTS = """
SELECT reason, count(*) AS n FROM (SELECT reason FROM judged WHERE reason IS NOT NULL
  UNION ALL SELECT status FROM headed WHERE status IN ('unresolved_version_conflict', 'known_withdrawal')) GROUP BY reason"""
_BASE = ctes("versions", "links")
_BOUND = "published_at IS NOT NULL AND evidence_raw_sha256 <> 'other'"

QUERIES = {
    "pit_observed_head": (observed_head, _BASE + _OBSERVED + _SELECTED_ALL),
    "pit_historical_head": (historical_head, _BASE + _published(_HISTORICAL_REASON, "greatest(published_at, revised_at)") + _SELECTED_ALL),
    "pit_assumed_head": (assumed_head, _BASE + _published(_ASSUMED_REASON.format(_UNKNOWN.format("")), _BY_DATE) + _SELECTED_ALL),
    "pit_exclusion_counts": (exclusions, _BASE + _OBSERVED + _COUNTS),
    "pit_historical_exclusions": (
        historical_exclusions,
        _BASE + _published(_HISTORICAL_REASON, "greatest(published_at, revised_at)", "WHEN session_scope <> 'regular' THEN 'session_scope_unverified_or_mismatch'") + _COUNTS,
    ),
    "pit_assumed_exclusions": (assumed_exclusions, _BASE + _published(_ASSUMED_REASON.format(_UNKNOWN.format("AND observation_end IS NULL")), _BY_RULE) + _COUNTS),
    "pit_version_conflicts": (conflicts, _BASE + _OBSERVED + f"\nSELECT {KEYS}, count(*) AS n_heads FROM headed WHERE status = 'unresolved_version_conflict' GROUP BY {KEYS}"),
    "pit_withdrawal": (withdrawals, _BASE + _OBSERVED + f"\nSELECT {KEYS}, version_id FROM headed WHERE status = 'known_withdrawal'"),
    "pit_superseded_ids": (
        superseded,
        _BASE
        + _OBSERVED
        + f"""
SELECT {KEYS}, max(version_id) FILTER (status = 'selected') AS version_id, coalesce(string_agg(version_id, ',' ORDER BY version_id) FILTER (status IN ('selected', 'equivalent')), '') AS equivalent_ids,
       coalesce(string_agg(version_id, ',' ORDER BY version_id) FILTER (status = 'superseded'), '') AS superseded_ids
FROM headed GROUP BY {KEYS} HAVING count(*) FILTER (status = 'selected') > 0""",
    ),
    "cross_source_disagreement": (
        disagreement,
        _BASE + _OBSERVED + """
SELECT security, trading_date, session_scope, price_semantics, count(DISTINCT source) AS n_sources, count(DISTINCT cents) AS n_values
FROM headed WHERE status = 'selected' GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT source) >= 2 AND count(DISTINCT cents) > 1""",
    ),
    "latest_failures": (
        failures,
        ctes("receipts") + f"""
SELECT receipt_id, request_id, received_at, status, previous_success_retained FROM (
  SELECT *, max(received_at) OVER (PARTITION BY request_id) AS last_at, bool_or(status = 'success') OVER (PARTITION BY request_id) AS previous_success_retained FROM receipts WHERE received_at <= {_C})
WHERE received_at = last_at AND status <> 'success'""",
    ),
    "stale_receipts": (
        stale,
        _BASE + _OBSERVED + f"""
SELECT source, date_diff('second', received_at, {_C}) / 3600.0 > 48 AS stale_receipt, count(*) AS n, round(max(date_diff('second', received_at, {_C}) / 3600.0), 6) AS oldest_hours
FROM headed WHERE status = 'selected' GROUP BY 1, 2""",
    ),
    "calendar_bound_reasons": (
        bounds,
        ctes("versions", "sessions") + f"""
SELECT coalesce(CASE WHEN v.trading_date > CAST((({_C} AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS DATE) THEN 'future_trading_date'
  WHEN observation_end IS NOT NULL AND observation_end_evidence IS NULL THEN 'observation_end_unproven' WHEN observation_end > {_C} THEN 'observation_period_not_finished'
  WHEN observation_end IS NULL AND s.trading_date IS NULL THEN 'calendar_date_unavailable' WHEN observation_end IS NULL AND s.known_at > {_C} THEN 'calendar_not_known_at_cutoff'
  WHEN observation_end IS NULL AND s.close_utc > {_C} THEN 'observation_period_not_finished' END, 'bounded') AS reason, count(*) AS n
FROM versions v LEFT JOIN sessions s ON s.trading_date = v.trading_date GROUP BY 1""",
    ),
    "symbol_effective": (
        symbols,
        ctes("versions", "assertions") + """
, rows AS (SELECT DISTINCT version_id, security, trading_date FROM versions
), day AS (SELECT DISTINCT trading_date FROM rows
), live AS (SELECT d.trading_date, a.symbol, a.security, a.exchange FROM day d JOIN assertions a ON a.effective_from <= d.trading_date AND (a.effective_to IS NULL OR d.trading_date < a.effective_to) WHERE a.record_state = 'active'
), shared AS (SELECT trading_date, symbol, count(DISTINCT (security, exchange)) > 1 AS many FROM live GROUP BY 1, 2
), owned AS (SELECT l.trading_date, l.security, bool_or(s.many) AS many, string_agg(DISTINCT l.symbol, ',' ORDER BY l.symbol) AS symbols FROM live l JOIN shared s ON s.trading_date = l.trading_date AND s.symbol = l.symbol GROUP BY 1, 2)
SELECT r.version_id, r.security, r.trading_date, CASE WHEN o.many THEN 'symbol_mapping_conflict' WHEN o.symbols IS NULL THEN 'no_eligible_effective_symbol_mapping' END AS mapping_reason,
       CASE WHEN NOT o.many THEN o.symbols END AS symbols
FROM rows r LEFT JOIN owned o ON o.trading_date = r.trading_date AND o.security = r.security""",
    ),
    "pit_asked_symbols": (
        asked_symbols,
        ctes("versions", "assertions") + f"""
, rows AS (SELECT DISTINCT version_id, security, trading_date FROM versions WHERE trading_date >= DATE '1993-01-01'
), day AS (SELECT DISTINCT trading_date FROM rows
), live AS (SELECT d.trading_date, a.symbol, a.security, a.exchange FROM day d JOIN assertions a ON a.effective_from <= d.trading_date AND (a.effective_to IS NULL OR d.trading_date < a.effective_to) WHERE a.record_state = 'active' AND a.symbol IN ({", ".join(f"'{w}'" for w in WANTED)})
), shared AS (SELECT trading_date, symbol, count(DISTINCT (security, exchange)) > 1 AS many FROM live GROUP BY 1, 2
), owned AS (SELECT l.trading_date, l.security, bool_or(s.many) AS many, string_agg(DISTINCT l.symbol, ',' ORDER BY l.symbol) AS symbols FROM live l JOIN shared s ON s.trading_date = l.trading_date AND s.symbol = l.symbol GROUP BY 1, 2)
SELECT r.version_id, r.security, r.trading_date, o.symbols FROM rows r JOIN owned o ON o.trading_date = r.trading_date AND o.security = r.security WHERE NOT o.many""",
    ),
    "pit_eligible_edges": (
        eligible_edges,
        ctes("versions") + """
, v AS (SELECT DISTINCT version_id, source, security, trading_date, coalesce(revised_at, published_at) AS tm, record_state = 'active' AS ok FROM versions WHERE identifier_verification = 'verified')
SELECT DISTINCT a.version_id AS earlier_id, b.version_id AS later_id FROM v a JOIN v b ON a.source = b.source AND a.security = b.security AND a.trading_date = b.trading_date AND a.tm < b.tm WHERE a.ok AND b.ok""",
    ),
    "pit_lineage_roots": (
        lineage_roots,
        ctes("versions").replace("WITH ", "WITH RECURSIVE ", 1) + """
, v AS (SELECT DISTINCT ON (version_id) *, coalesce(revised_at, published_at) AS tm FROM versions WHERE identifier_verification = 'verified')
, s AS (SELECT source, security, trading_date, tm, min(value_hash) AS lo, max(value_hash) AS hi, min(version_id) AS id FROM v WHERE tm IS NOT NULL GROUP BY 1, 2, 3, 4)
, l AS (SELECT *, lag(lo) OVER w AS plo, lag(hi) OVER w AS phi, lag(id) OVER w AS pid FROM s WINDOW w AS (PARTITION BY source, security, trading_date ORDER BY tm))
, e AS (SELECT version_id FROM v WHERE record_state = 'active')
, p AS (SELECT v.version_id, CASE WHEN plo = phi AND plo <> v.value_hash AND pid IN (SELECT version_id FROM e) THEN pid END AS prev FROM v LEFT JOIN l ON l.source = v.source AND l.security = v.security AND l.trading_date = v.trading_date AND l.tm = v.tm WHERE v.record_state = 'active')
, c AS (SELECT version_id, version_id AS root_id, 0::BIGINT AS depth FROM p UNION ALL SELECT c.version_id, p.prev, c.depth + 1 FROM c JOIN p ON p.version_id = c.root_id WHERE p.prev IS NOT NULL)
SELECT version_id, arg_max(root_id, depth) AS root_id, max(depth) AS depth FROM c GROUP BY 1""",
    ),
    "assumed_available_ts": (assumed_clock, ctes("versions") + f"\nSELECT DISTINCT publication_date, {_LOCAL} AS available_at FROM versions WHERE publication_date IS NOT NULL"),
    "previous_version": (
        previous,
        ctes("versions") + f"""
, v AS (SELECT DISTINCT ON (version_id) *, greatest(published_at, revised_at) AS at_time FROM versions WHERE {_BOUND}
), step AS (SELECT source, security, trading_date, at_time, min(value_hash) AS lo, max(value_hash) AS hi, min(version_id) AS id FROM v GROUP BY 1, 2, 3, 4
), back AS (SELECT source, security, trading_date, at_time, lag(lo) OVER w AS lo, lag(hi) OVER w AS hi, lag(id) OVER w AS id FROM step WINDOW w AS (PARTITION BY source, security, trading_date ORDER BY at_time))
SELECT v.version_id, CASE WHEN b.lo = b.hi AND b.lo <> v.value_hash THEN b.id END AS previous_version_id
FROM v LEFT JOIN back b ON b.source = v.source AND b.security = v.security AND b.trading_date = v.trading_date AND b.at_time = v.at_time""",
    ),
    "version_edges": (
        edges,
        ctes("versions") + f"""
, v AS (SELECT *, greatest(published_at, revised_at) AS at_time FROM versions WHERE {_BOUND})
SELECT DISTINCT a.version_id AS earlier_id, b.version_id AS later_id FROM v a JOIN v b ON a.source = b.source AND a.security = b.security AND a.trading_date = b.trading_date AND a.at_time < b.at_time""",
    ),
}
