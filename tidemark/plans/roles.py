"""The engine's input tables, derived by rule from the star-schema tables.

Each role is a query in the SQL that Spark and DuckDB share, with a few names that differ filled in,
so that both sides of a comparison start from the same rows. Series of versions are suppliers, dense
series of bars are nations, both by week; receipts are orders.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SPARK = {"week": "trunc(cast({} as date), 'week')", "ts": "timestamp_ntz", "hash": "sha2({}, 256)", "int_div": "({} div {})"}
DUCK = {"week": "cast(date_trunc('week', {}) as date)", "ts": "timestamp", "hash": "sha256({})", "int_div": "({} // {})"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ROLES = {
    "ticks": """
SELECT s.s_nationkey AS security, {week:l.l_shipdate} AS trading_date, l.l_extendedprice / l.l_quantity AS price, l.l_quantity AS quantity,
       row_number() OVER (PARTITION BY s.s_nationkey, {week:l.l_shipdate} ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_extendedprice, l.l_quantity) AS place,
       count(*) OVER (PARTITION BY s.s_nationkey, {week:l.l_shipdate}) AS places
FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey""",
    "bars": """
SELECT security, trading_date, max(CASE WHEN place = 1 THEN price END) AS open, max(price) AS high, min(price) AS low,
       max(CASE WHEN place = places THEN price END) AS close, CAST(sum(quantity) AS BIGINT) AS volume
FROM ticks GROUP BY security, trading_date""",
    "sourced_bars": """
SELECT s.s_nationkey AS security, {week:l.l_shipdate} AS trading_date, CASE WHEN l.l_partkey % 2 = 0 THEN 'alpha' ELSE 'beta' END AS source, max(CASE WHEN l.l_linenumber = 1 THEN l.l_extendedprice END) AS open, max(l.l_extendedprice) AS high, min(l.l_extendedprice) AS low,
       max(CASE WHEN l.l_linenumber = 2 THEN l.l_extendedprice END) AS close, CAST(sum(CAST(l.l_quantity AS INT)) AS BIGINT) AS volume
FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey GROUP BY 1, 2, 3""",
    "sessions": """
SELECT trading_date, CAST(row_number() OVER (ORDER BY trading_date) - 1 AS BIGINT) AS idx, 'weekly-1' AS calendar_version,
       CAST(trading_date AS {ts}) + INTERVAL '14' HOUR + INTERVAL '30' MINUTE AS open_utc, CAST(trading_date AS {ts}) + INTERVAL '21' HOUR AS close_utc,
       CAST(trading_date AS {ts}) - INTERVAL '30' DAY AS known_at, CAST(trading_date AS {ts}) - INTERVAL '60' DAY AS publication_at
FROM (SELECT DISTINCT trading_date FROM bars) d""",
    "versions": """
SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_quantity AS INT) AS STRING)) AS version_id,
       concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING)) AS artifact_id, l_suppkey AS security,
       {week:l_shipdate} AS trading_date, CASE WHEN l_partkey % 2 = 0 THEN 'alpha' ELSE 'beta' END AS source,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, {hash:CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)} AS value_hash,
       CASE WHEN l_partkey % 11 <> 0 THEN 'verified' ELSE 'temporary' END AS identifier_verification,
       CASE WHEN l_returnflag = 'A' THEN 'split_adjusted' ELSE 'as_traded' END AS price_semantics,
       CASE WHEN l_suppkey % 13 <> 0 THEN 'regular' ELSE 'unverified' END AS session_scope,
       CASE WHEN l_tax > 0.07 THEN 'withdrawn' ELSE 'active' END AS record_state,
       CASE WHEN CAST(l_quantity AS INT) % 3 <> 0 THEN CAST(l_shipdate AS {ts}) + INTERVAL '9' HOUR END AS published_at,
       CASE WHEN CAST(l_quantity AS INT) % 5 = 0 THEN CAST(l_shipdate AS {ts}) + INTERVAL '72' HOUR END AS revised_at,
       CASE WHEN CAST(l_quantity AS INT) % 6 = 0 THEN CAST(l_shipdate AS DATE) END AS publication_date,
       CASE WHEN CAST(l_quantity AS INT) % 12 = 0 THEN 'America/New_York' WHEN CAST(l_quantity AS INT) % 24 = 18 THEN 'UTC' END AS publication_timezone,
       CASE WHEN l_partkey % 4 <> 0 THEN concat('raw', CAST(l_orderkey AS STRING)) ELSE 'other' END AS evidence_raw_sha256,
       CASE WHEN l_linenumber = 1 THEN CAST(l_shipdate AS {ts}) + INTERVAL '21' HOUR END AS observation_end,
       CASE WHEN l_linenumber = 1 AND l_partkey % 3 <> 0 THEN 'reference_session' END AS observation_end_evidence
FROM lineitem""",
    "links": """
SELECT DISTINCT concat_ws('-', CAST(l.l_orderkey AS STRING), CAST(l.l_linenumber AS STRING)) AS artifact_id, concat('r', CAST(o.o_orderkey AS STRING)) AS receipt_id,
       CAST(o.o_orderdate AS {ts}) AS received_at, CAST(o.o_orderdate AS {ts}) + INTERVAL '1' HOUR * l.l_linenumber AS usable_at,
       CAST(CASE WHEN o.o_custkey % 9 = 0 THEN NULL ELSE o.o_custkey % 10 <> 0 END AS BOOLEAN) AS network_performed,
       CASE WHEN o.o_orderstatus = 'P' THEN 'rate_limited' ELSE 'success' END AS status, concat('raw', CAST(o.o_orderkey AS STRING)) AS raw_sha256
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""",
    "receipts": """
SELECT concat('r', CAST(o_orderkey AS STRING)) AS receipt_id, concat('q', CAST(o_custkey AS STRING)) AS request_id, CAST(o_orderdate AS {ts}) AS received_at,
       CASE WHEN o_orderstatus = 'P' OR o_orderkey % 7 = 0 THEN 'rate_limited' ELSE 'success' END AS status
FROM orders""",
    "assertions": """
SELECT concat('a', CAST(s_suppkey AS STRING), '-', CAST(k AS STRING)) AS assertion_id, concat('SYM', CAST((s_suppkey * 7 + k * s_suppkey % 5) % 90 AS STRING)) AS symbol,
       s_suppkey AS security, 'XNYS' AS exchange, CAST(CASE WHEN k = 0 THEN DATE '1992-01-01' ELSE DATE '1996-01-01' END AS DATE) AS effective_from,
       CAST(CASE WHEN k = 0 THEN DATE '1996-01-01' END AS DATE) AS effective_to, CASE WHEN s_suppkey % 17 = 0 AND k = 1 THEN 'withdrawn' ELSE 'active' END AS record_state,
       CAST(DATE '1991-06-01' AS {ts}) AS order_at
FROM supplier CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) t""",
    "dated_actions": """
SELECT concat('e', CAST(event_id AS STRING)) AS version_id, CAST(user_id % 25 AS INT) AS security, CASE WHEN event_type = 'signup' THEN 'split' ELSE 'dividend' END AS event_type,
       CAST(DATE '1992-01-06' + INTERVAL '7' DAY * (event_id * 13 % 350) AS DATE) AS ex_date, CASE WHEN event_type = 'signup' THEN 1 + event_id % 3 END AS numerator,
       CASE WHEN event_type = 'signup' THEN 1 + event_id % 2 END AS denominator, CASE WHEN event_type <> 'signup' THEN CAST(event_id % 50 AS DOUBLE) / 100 END AS amount
FROM events""",
    "outcomes": """
SELECT o_orderkey AS sample_id, CAST(o_orderdate AS DATE) AS decision_date, CAST(o_custkey AS BIGINT) AS security,
       (CAST(o_orderkey * 37 % 401 AS DOUBLE) - 200) / 1000 AS actual, (CAST(o_orderkey * 53 % 301 AS DOUBLE) - 150) / 1000 AS predicted,
       CAST(o_orderkey * 29 % 101 AS DOUBLE) / 100 AS probability, o_orderkey % 97 <> 0 AS mature
FROM orders""",
    "samples": """
SELECT CAST(o_orderkey AS STRING) AS sample_id, o_custkey AS security, CAST(o_orderdate AS DATE) AS decision_date, CAST(o_orderdate AS {ts}) + INTERVAL '22' HOUR AS decision_at,
       CASE WHEN o_orderkey % 23 <> 0 THEN CAST(o_orderdate AS {ts}) + INTERVAL '1' HOUR * (o_orderkey % 48) END AS feature_ready_at, CAST(o_orderdate AS {ts}) + INTERVAL '38' HOUR AS intended_entry_at,
       CASE WHEN o_orderkey % 31 <> 0 THEN CAST(o_orderdate AS {ts}) + INTERVAL '24' HOUR * (5 + o_orderkey % 4) END AS intended_exit_at, CASE WHEN o_orderkey % 19 = 0 THEN 'blocked' ELSE 'ready' END AS sample_status,
       CASE WHEN o_orderkey % 13 = 0 THEN 'pending' ELSE 'ready' END AS label_status, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS {ts}) + INTERVAL '24' HOUR * (7 + o_orderkey % 30) END AS label_available_at,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS {ts}) + INTERVAL '2400' HOUR END AS rights_available_at, o_orderkey % 29 <> 0 AS learning_ready
FROM orders""",
    "learning": """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey * 41 % 211 AS DOUBLE) / 100 END AS x1, CAST(o_orderkey * 67 % 127 AS DOUBLE) / 50 AS x2,
       CAST(o_orderkey * 41 % 211 AS DOUBLE) / 200 - CAST(o_orderkey * 67 % 127 AS DOUBLE) / 150 + CAST(o_orderkey * 97 % 53 AS DOUBLE) / 500 - 0.15 AS y
FROM orders""",
    "predictions": """
SELECT concat('p', CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 59 = 0 THEN 'x' ELSE '' END) AS prediction_id, CAST(o_orderkey - CASE WHEN o_orderkey % 61 = 0 THEN 1 ELSE 0 END AS STRING) AS sample_id,
       CAST(CASE WHEN o_orderkey % 37 = 0 THEN 20 ELSE 5 END AS INT) AS horizon, 'm' AS model_or_signal_id, CASE WHEN o_orderkey % 67 <> 0 THEN '1' END AS model_version,
       CASE WHEN o_orderkey % 43 = 0 THEN 'strict' ELSE 'research' END AS mode, CASE WHEN o_orderkey % 47 = 0 THEN '0' ELSE '1' END AS prediction_version, CASE WHEN o_orderkey % 71 = 0 THEN 'other' ELSE 'set' END AS dataset_snapshot_id,
       'hash' AS dataset_content_sha256, concat('f', CAST(o_orderkey AS STRING)) AS feature_version_id, concat('fs', CAST(o_orderkey AS STRING)) AS feature_snapshot_id,
       CASE WHEN o_orderkey % 73 = 0 THEN 'ranking' WHEN o_orderkey % 3 = 0 THEN 'regression' WHEN o_orderkey % 3 = 1 THEN 'classification' ELSE 'legacy_joint' END AS output_task,
       CASE WHEN o_orderkey % 79 = 0 THEN 'volume' WHEN o_orderkey % 4 = 0 THEN 'cash_total_return' ELSE 'price_return' END AS target_id,
       CASE WHEN o_orderkey % 3 <> 1 OR o_orderkey % 83 = 0 THEN (CAST(o_orderkey * 53 % 301 AS DOUBLE) - 150) / 1000 END AS predicted_return,
       CASE WHEN o_orderkey % 3 <> 0 OR o_orderkey % 89 = 0 THEN CAST(o_orderkey * 29 % 101 AS DOUBLE) / 100 + CASE WHEN o_orderkey % 53 = 0 THEN 1 ELSE 0 END END AS probability_up,
       CASE WHEN o_orderkey % 2 = 0 THEN -0.1 + CASE WHEN o_orderkey % 31 = 0 THEN 0.5 ELSE 0 END END AS q10, CASE WHEN o_orderkey % 2 = 0 THEN 0.1 END AS q90, CASE WHEN o_orderkey % 97 = 0 THEN '1.5' ELSE '0.9' END AS upper_level,
       CAST(o_orderdate AS {ts}) - INTERVAL '1' DAY * (o_orderkey % 30 - 2) AS training_asof, CAST(o_orderdate AS {ts}) + INTERVAL '1' HOUR * (20 + o_orderkey % 20) AS generated_at,
       CASE WHEN o_orderkey % 41 <> 0 THEN CAST(o_orderdate AS {ts}) + INTERVAL '23' HOUR END AS simulated_generated_at, CASE WHEN o_orderkey % 29 = 0 THEN 'manual' WHEN o_orderkey % 5 = 0 THEN 'operational' ELSE 'replay' END AS generation_kind,
       CAST(o_orderdate AS {ts}) + INTERVAL '22' HOUR AS decision_at, CAST(o_orderdate AS {ts}) + INTERVAL '38' HOUR AS intended_entry_at, o_orderkey % 101 = 0 AS oracle
FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL
SELECT concat('p', CAST(o_orderkey AS STRING)), CAST(o_orderkey AS STRING), 5, 'm', '1', 'research', '1', 'set', 'hash', concat('f', CAST(o_orderkey AS STRING)), concat('fs', CAST(o_orderkey AS STRING)), 'regression', 'price_return', CAST(0.01 AS DOUBLE), NULL, NULL, NULL, '0.9',
       CAST(o_orderdate AS {ts}), CAST(o_orderdate AS {ts}) + INTERVAL '23' HOUR, CAST(o_orderdate AS {ts}) + INTERVAL '23' HOUR, 'replay', CAST(o_orderdate AS {ts}) + INTERVAL '22' HOUR, CAST(o_orderdate AS {ts}) + INTERVAL '38' HOUR, false
FROM orders WHERE o_orderkey % 103 = 0""",
    "pairs": """
SELECT CAST(o_orderkey AS STRING) AS sample_id, CAST(5 AS INT) AS horizon, o_custkey AS security, CAST(o_orderdate AS DATE) AS decision_date, CAST(o_orderdate AS {ts}) + INTERVAL '22' HOUR AS decision_at,
       CAST(o_orderdate AS {ts}) + INTERVAL '1' HOUR * CASE WHEN o_orderkey % 17 = 0 THEN 26 ELSE 22 END AS feature_ready_at, CAST(o_orderdate AS {ts}) + INTERVAL '38' HOUR + INTERVAL '1' HOUR * CASE WHEN o_orderkey % 107 = 0 THEN 1 ELSE 0 END AS intended_entry_at,
       concat('f', CAST(o_orderkey AS STRING)) AS feature_version_id, concat('fs', CAST(o_orderkey AS STRING)) AS feature_snapshot_id, CASE WHEN o_orderkey % 19 = 0 THEN 'blocked' ELSE 'ready' END AS sample_status,
       CASE WHEN o_orderkey % 13 = 0 THEN 'pending' ELSE 'ready' END AS label_status, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS {ts}) + INTERVAL '24' HOUR * (7 + o_orderkey % 30) END AS label_available_at,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS {ts}) + INTERVAL '2400' HOUR END AS rights_available_at, CASE WHEN o_orderkey % 6 = 0 THEN 'blocked' ELSE 'ready' END AS cash_total_return_status, o_orderkey % 23 <> 0 AS learning_allowed,
       CASE WHEN o_orderkey % 27 <> 0 THEN (CAST(o_orderkey * 37 % 401 AS DOUBLE) - 200) / 1000 END AS price_return, (CAST(o_orderkey * 37 % 401 AS DOUBLE) - 190) / 1000 AS cash_total_return,
       CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey * 41 % 211 AS DOUBLE) / 100 END AS x1, CASE WHEN o_orderkey % 17 = 0 THEN 'missing_session_or_collection_failure' END AS x1_reason,
       CASE WHEN o_orderkey % 33 <> 0 THEN CAST(o_orderkey * 67 % 127 AS DOUBLE) / 50 END AS x2, CASE WHEN o_orderkey % 33 = 0 THEN 'unknown_meaning_or_currency' END AS x2_reason
FROM orders""",
}
NEEDS = {"bars": ["ticks"], "sessions": ["bars"]}


def _fill(sql: str, words: dict[str, str]) -> str:
    def put(match: re.Match) -> str:
        name, _, argument = match[1].partition(":")
        return words[name].format(argument)

    return re.sub(r"\{(\w+(?::[^{}]+)?)\}", put, sql)


def _order(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        out += [n for n in (*_order(tuple(NEEDS.get(name, ()))), name) if n not in out]
    return out


def ctes(*names: str) -> str:
    """WITH clause of the named roles for DuckDB."""
    parts = [f"{n} AS ({_fill(ROLES[n], DUCK)}\n)" for n in _order(names)]
    return "WITH " + ",\n".join(parts).replace("AS STRING", "AS VARCHAR")


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A role as a DataFrame over the Parquet tables of ``sf_dir``."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", " ".join(ROLES[n] for n in _order((name,))))}
    names = _order((name,))
    sql = ", ".join(f"{n} AS ({_fill(ROLES[n], SPARK)})" for n in names)
    sql = f"WITH {sql} SELECT * FROM {name}"
    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **tables)
