"""Hand-calculated cases and leakage checks of the engine's operators."""

import datetime as dt
import json
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import values
from tidemark.operators import bars, calendar, datasets, features, ingest, labels, metrics, models, pit, simulation
from tidemark.sources import providers, store
from tidemark.streaming import cycle

UTC = dt.timezone.utc


def at(text):
    return dt.datetime.fromisoformat(text)


VERSION = "version_id string, artifact_id string, source string, security string, trading_date date, value_hash string, published_at timestamp, revised_at timestamp, publication_date date, publication_timezone string, evidence_raw_sha256 string, identifier_verification string, price_semantics string, session_scope string, record_state string, observation_end timestamp"
LINK = "artifact_id string, receipt_id string, received_at timestamp, usable_at timestamp, network_performed boolean, status string, raw_sha256 string"
KEY = ["source", "security", "trading_date"]
DAY = dt.date(2024, 1, 2)


def version(n, value, published=None, revised=None, date=None, bound=True, state="active"):
    return (f"v{n}", f"a{n}", "s", "x", DAY, value, published and at(published), revised and at(revised), date, "America/New_York" if date else None, f"raw{n}" if bound else None, "verified", "as_traded", "regular", state, None)


def link(n, received, usable=None, network=True, status="success"):
    return (f"a{n}", f"r{n}", at(received), at(usable or received), network, status, f"raw{n}")


def heads(spark, versions, links, cutoff, policy, rule=None):
    found = pit.pit_query(spark.createDataFrame(versions, VERSION), spark.createDataFrame(links, LINK), cutoff=F.lit(at(cutoff)), policy=policy, key=KEY, rule=rule)
    return [r.value_hash for r in found["data"].collect()], {r.reason: r.n for r in found["exclusions"].collect()}


RULE = {"timezone": "America/New_York", "delay_hours": 1}
FIRST, CORRECTED = version(1, "100", "2024-01-02 22:00:00"), version(2, "110", "2024-01-02 22:00:00", "2024-01-05 22:00:00")
LINKS = [link(1, "2024-01-03 00:00:00"), link(2, "2024-01-06 00:00:00")]


def test_initial_and_correction(spark):
    assert heads(spark, [FIRST, CORRECTED], LINKS, "2024-01-03 22:00:00", "historical_verified")[0] == ["100"]
    assert heads(spark, [FIRST, CORRECTED], LINKS, "2024-01-06 22:00:00", "historical_verified")[0] == ["110"]
    assert heads(spark, [FIRST, CORRECTED], LINKS, "2024-01-03 22:00:00", "observed")[0] == ["100"]


def test_policies_do_not_fall_back(spark):
    late = [version(1, "100", "2024-01-02 22:00:00")]
    receipt = [link(1, "2024-01-09 00:00:00")]
    assert heads(spark, late, receipt, "2024-01-03 22:00:00", "observed") == ([], {"received_after_cutoff": 1})
    assert heads(spark, late, receipt, "2024-01-03 22:00:00", "historical_verified")[0] == ["100"]
    dated = [version(1, "100", date=DAY)]
    assert heads(spark, dated, receipt, "2024-01-06 22:00:00", "historical_verified") == ([], {"publication_date_only": 1})
    assert heads(spark, dated, receipt, "2024-01-03 05:59:00", "research_assumed", RULE) == ([], {"assumed_publication_after_cutoff": 1})
    assert heads(spark, dated, receipt, "2024-01-04 06:00:00", "research_assumed", RULE)[0] == ["100"]
    with pytest.raises(ValueError):
        heads(spark, dated, receipt, "2024-01-04 06:00:00", "observed", RULE)


def test_conflict_withdrawal_and_equal_values(spark):
    same = "2024-01-02 22:00:00"
    conflict = [version(1, "100", same), version(2, "101", same)]
    assert heads(spark, conflict, LINKS, "2024-01-06 22:00:00", "historical_verified") == ([], {"unresolved_version_conflict": 2})
    assert heads(spark, [version(1, "100", same), version(2, "100", same)], LINKS, "2024-01-06 22:00:00", "historical_verified") == (["100"], {})
    gone = [FIRST, version(2, "110", same, "2024-01-05 22:00:00", state="withdrawn")]
    assert heads(spark, gone, LINKS, "2024-01-06 22:00:00", "historical_verified") == ([], {"known_withdrawal": 1})
    assert heads(spark, gone, LINKS, "2024-01-03 22:00:00", "historical_verified")[0] == ["100"]


def test_rows_after_the_cutoff_change_nothing(spark):
    before = heads(spark, [FIRST], LINKS, "2024-01-03 22:00:00", "observed")
    later = [FIRST, CORRECTED, version(3, "999", "2024-02-01 00:00:00")]
    assert heads(spark, later, [*LINKS, link(3, "2024-02-01 00:00:00")], "2024-01-03 22:00:00", "observed")[0] == before[0]


def test_unproven_and_unfinished_receipts(spark):
    rows = [version(1, "100"), version(2, "100")]
    found = heads(spark, rows, [link(1, "2024-01-03 00:00:00", network=None), link(2, "2024-01-03 00:00:00", "2024-01-09 00:00:00")], "2024-01-04 00:00:00", "observed")
    assert found == ([], {"actual_receipt_unproven": 1, "processing_after_cutoff": 1})


def test_local_midnight_across_the_clock_change(spark):
    out = spark.sql("SELECT DATE '2024-03-10' AS d").select(values.assumed_available(F.col("d"), "America/New_York", 1).cast("string").alias("t")).first()
    assert out.t == "2024-03-11 05:00:00"


def test_symbol_conflict_and_withdrawal(spark):
    rows = spark.createDataFrame([("x", DAY), ("y", DAY), ("z", DAY)], "security string, trading_date date")
    day = dt.date(2020, 1, 1)
    told = [("a1", "AAA", "x", "E", day, None, "active", at("2020-01-01 00:00:00")), ("a2", "BBB", "y", "E", day, None, "active", at("2020-01-01 00:00:00")), ("a3", "BBB", "z", "E", day, dt.date(2024, 1, 3), "active", at("2020-01-01 00:00:00"))]
    schema = "assertion_id string, symbol string, security string, exchange string, effective_from date, effective_to date, record_state string, order_at timestamp"
    out = {r.security: (r.mapping_reason, r.symbols) for r in pit.resolve_symbols(rows, spark.createDataFrame(told, schema)).collect()}
    assert out["x"] == (None, ["AAA"]) and out["y"][0] == out["z"][0] == "symbol_mapping_conflict"
    gone = [*told[:2], ("a3", "BBB", "z", "E", day, None, "withdrawn", at("2020-02-01 00:00:00"))]
    out = {r.security: r.mapping_reason for r in pit.resolve_symbols(rows, spark.createDataFrame(gone, schema)).collect()}
    assert out == {"x": None, "y": None, "z": "no_eligible_effective_symbol_mapping"}


def weekdays(n, start=dt.date(2024, 1, 1)):
    days, d = [], start
    while len(days) < n:
        if d.weekday() < 5:
            days.append(d)
        d += dt.timedelta(days=1)
    return days


def calendar_of(spark, n):
    rows = [("c1", d, dt.datetime.combine(d, dt.time(14, 30)), dt.datetime.combine(d, dt.time(21))) for d in weekdays(n)]
    return calendar.indexed(spark.createDataFrame(rows, "calendar_version string, trading_date date, open_utc timestamp, close_utc timestamp"))


def test_plan_counts_sessions_from_the_entry(spark):
    out = {r.decision_date: r for r in calendar.plan(calendar_of(spark, 30)).collect()}
    days = weekdays(30)
    first = out[days[0]]
    assert first.decision_at == dt.datetime.combine(days[0], dt.time(22)) and first.entry_date == days[1]
    assert (first.exit_date_1, first.exit_date_5, first.exit_date_20) == (days[2], days[6], days[21])
    assert out[days[29]].intended_entry_at is None and out[days[28]].exit_date_1 is None


def bar_rows(closes, days):
    return [("x", d, c, c * 1.01 if c else c, c * 0.99 if c else c, c, 100) for d, c in zip(days, closes) if c is not None]


BARS = "security string, trading_date date, open double, high double, low double, close double, volume bigint"


def feature_rows(spark, closes):
    sessions = calendar_of(spark, len(closes))
    dense = calendar.spine(spark.createDataFrame(bar_rows(closes, weekdays(len(closes))), BARS), sessions, ["security"])
    return {r.idx: r for r in features.features(dense, ["security"]).collect()}


def test_features_by_hand(spark):
    rows = feature_rows(spark, [100.0] * 63 + [110.0, 121.0])
    last = rows[64]
    assert math.isclose(last.close_price_change_1, 0.1) and math.isclose(last.close_price_change_5, 0.21)
    assert math.isclose(last.close_to_ma_20, 389 / 2031) and math.isclose(last.realized_log_price_change_volatility_5, math.sqrt(0.3) * math.log(1.1))
    assert math.isclose(last.intraday_high_low_ratio, 1.01 / 0.99 - 1) and last.volume_to_prior20_mean == 1
    assert rows[62].close_price_change_60 == 0 and rows[3].close_price_change_5_reason == "lookback_outside_calendar"


def test_gaps_are_not_filled(spark):
    closes = [None] * 10 + [100.0] * 20 + [None] + [100.0] * 9
    rows = feature_rows(spark, closes)
    assert rows[11].close_price_change_5_reason == "insufficient_history_or_prelisting_unverified"
    assert rows[31].close_price_change_1_reason == "missing_session_or_collection_failure" and rows[32].close_price_change_1 == 0
    assert rows[30].elapsed_sessions == 1 and rows[30].intraday_high_low_ratio_reason == "missing_session_or_collection_failure"


def test_future_prices_do_not_change_past_features(spark):
    closes = [100.0 + i for i in range(70)]
    a, b = feature_rows(spark, closes), feature_rows(spark, closes[:66] + [1.0, 500.0, 3.0, 9.0])
    assert all(a[i] == b[i] for i in range(66))


def test_ledger_split_and_dividend(spark):
    rows = spark.createDataFrame([("x", 1, dt.date(2024, 1, 3), dt.date(2024, 1, 10), 100.0, 55.0)], "security string, id int, entry_date date, exit_date date, entry_open double, exit_open double")
    told = [("s", "x", "split", dt.date(2024, 1, 5), 2, 1, None, None), ("d", "x", "dividend", dt.date(2024, 1, 8), None, None, 1.0, dt.date(2024, 1, 10)), ("o", "x", "split", dt.date(2024, 1, 3), 9, 1, None, None)]
    actions = spark.createDataFrame(told, "version_id string, security string, event_type string, ex_date date, numerator int, denominator int, amount double, payment_date date")
    out = labels.ledger(rows, actions, ["security"], ["id"]).first()
    assert math.isclose(out.price_return, 0.1) and math.isclose(out.cash_return, 0.12) and (out.paid, out.receivable, out.n_actions) == (0.0, 2.0, 2)
    assert math.isclose(labels.ledger(rows, actions, ["security"], ["id"], include_receivables=False).first().cash_return, 0.1)


def test_ledger_goes_on_where_the_product_leaves_doubles(spark):
    day = dt.date(2020, 1, 1)
    told = [(f"{k:04}", "x", "split", day + dt.timedelta(days=1 + k), *((2, 1) if (k < 1100) == up else (1, 2)), None, None, s) for s, up in (("up", True), ("down", False)) for k in range(2200)]
    told += [("9998", "x", "split", day + dt.timedelta(days=2300), n, d, None, None, s) for s, n, d in (("up", 3, 1), ("down", 3, 1), ("none", 0, 1))]
    told += [("9999", "x", "split", day + dt.timedelta(days=2301), 2, 1, None, None, "none")]
    actions = spark.createDataFrame(told, "version_id string, source string, event_type string, ex_date date, numerator int, denominator int, amount double, payment_date date, security string")
    rows = spark.createDataFrame([(s, day, day + dt.timedelta(days=2400), 100.0, 50.0) for s in ("up", "down", "none")], "security string, entry_date date, exit_date date, entry_open double, exit_open double")
    found = {r.security: r.quantity for r in labels.ledger(rows, actions, ["security"], ["security"]).collect()}
    assert math.isclose(found["up"], 3, rel_tol=1e-9) and math.isclose(found["down"], 3, rel_tol=1e-9) and found["none"] == 0


def test_guard_order_and_halts(spark):
    df = spark.sql("SELECT true AS a, true AS b")
    assert labels.with_status(df, {"open_invalid": F.col("a"), "conflict": F.col("b")}).first().reason == "unresolved_label_query_conflict"
    assert labels.with_status(df, {}).first().status == "ready"
    t = [F.lit(at(f"2024-01-0{d} 00:00:00")) for d in (1, 2, 3, 4)]
    halted = F.array(F.struct(t[0].alias("start_at"), t[1].alias("resumed_at")))
    out = df.select(labels.halt_reason(halted, t[1], t[3], F.lit(True)).alias("edge"), labels.halt_reason(halted, t[2], t[3], F.lit(True)).alias("after"), labels.halt_reason(halted, t[2], t[3], F.lit(False)).alias("unknown")).first()
    assert out.edge == "target_security_halted_no_price_substitution" and out.after is None and out.unknown == "halt_coverage_incomplete"


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([(DAY, s, a, p, 0.4) for s, a, p in (("a", 0.02, 0.0), ("b", 0.02, 0.04), ("c", 0.02, 0.0), ("d", 0.02, 0.04))], "decision_date date, security string, actual double, predicted double, probability double")
    out = metrics.row_weighted(rows.withColumns(metrics.scores(F.col("actual"), F.col("predicted"), F.col("probability")))).first()
    assert math.isclose(out.mae, 0.02) and math.isclose(out.mse, 0.0004) and math.isclose(out.brier, 0.36) and math.isclose(out.binary_log_loss, -math.log(0.4))
    assert metrics.rank_ic(rows).first().reason == "constant_predictions_or_targets"
    tied = spark.createDataFrame([(DAY, "a", 1.0, 1.0), (DAY, "b", 2.0, 2.0), (DAY, "c", 2.0, 2.0)], "decision_date date, security string, predicted double, actual double")
    assert math.isclose(metrics.rank_ic(tied).first().rank_ic, 1.0)
    assert [r.n for r in metrics.calibration(rows).orderBy("bin").collect()] == [0, 0, 0, 0, 4, 0, 0, 0, 0, 0]


def test_ridge_closed_form_and_constants(spark):
    rows = spark.createDataFrame([(float(i), 2.0 * i + 3) for i in range(10)], "x double, y double")
    predict = models.fit(rows, ["x"], "y", "ridge")
    for r in predict(rows).collect():
        assert math.isclose(r.prediction, 12 + 10 / 11 * 2 * (r.x - 4.5), abs_tol=1e-9)
    assert models.fit(spark.createDataFrame([(float(i), 2.0) for i in (3, 4)], "y double, x double"), [], "y", "mean")(rows).first().prediction == 3.5
    up = spark.createDataFrame([(1.0,)] * 2 + [(-1.0,)] * 6, "y double")
    assert math.isclose(models.fit(up, [], "y", "frequency")(rows).first().prediction, 0.3)


ACTIONS = "array<struct<version_id:string,event_type:string,numerator:double,denominator:double,amount:double,payment_date:date>>"


def test_quotes_round_half_to_even(spark):
    out = spark.sql("SELECT CAST(0.125 AS DECIMAL(10,3)) AS a, CAST(0.135 AS DECIMAL(10,3)) AS b").select(values.money(F.col("a")).alias("a"), values.money(F.col("b")).alias("b")).first()
    assert (out.a, out.b) == (Decimal("0.12"), Decimal("0.14"))


def test_drawdown(spark):
    nav = spark.createDataFrame([("r", i, v) for i, v in enumerate([1000.0, 1100.0, 900.0, 900.0])], "run string, i int, nav double")
    assert math.isclose(simulation.drawdown(nav, ["run"], "i").first().max_drawdown, 200 / 1100)


def test_strict_values(spark):
    rows = spark.createDataFrame([("2024-01-02T00:00:00Z", "2024-01-02", "1.5"), ("2024-01-02 00:00:00", "2024-1-2", "true"), ("2024-01-02T00:00:00", "2024-02-30", "NaN")], "t string, d string, n string")
    out = rows.select(values.instant(F.col("t")).alias("t"), values.day(F.col("d")).alias("d"), values.number(F.col("n")).alias("n")).collect()
    assert [r.n for r in out] == [1.5, None, None] and [r.d for r in out] == [DAY, None, None] and out[0].t and not out[1].t and not out[2].t


def test_bar_issues_and_duplicates(spark):
    rows = spark.createDataFrame([("x", DAY, 1.0, 2.0, 0.5, 1.5, 5), ("x", DAY, 1.0, 1.2, 0.5, 1.5, 0), ("x", DAY, None, 1.0, 1.0, 1.0, -1)], BARS)
    found = [r.codes for r in rows.select(bars.issue_codes().alias("codes")).collect()]
    assert found == [[], ["inconsistent_ohlc", "reported_zero_volume_not_proof_of_no_trading"], ["missing_price", "negative_volume"]]
    codes = bars.duplicates(rows.withColumn("n", F.monotonically_increasing_id()), ["security", "trading_date"], ["n"], ["close"]).select("code").collect()
    assert sorted(r.code for r in codes) == ["conflicting_duplicate", "duplicate_key"]


def test_chart_response(spark):
    body = {"chart": {"result": [{"meta": {"exchangeTimezoneName": "America/New_York"}, "timestamp": [1704205800], "indicators": {"quote": [{"open": [1], "high": [2], "low": [1], "close": [None], "volume": [0]}], "adjclose": [{"adjclose": [1.5]}]}, "events": {"splits": {"k": {"date": 1704205800, "numerator": 2, "denominator": 1}}}}]}}
    uneven = json.loads(json.dumps(body))
    uneven["chart"]["result"][0]["timestamp"].append(1)
    df = spark.createDataFrame([("a", json.dumps(body)), ("b", json.dumps(uneven)), ("c", "not json")], "request_id string, body string")
    out = {r.request_id: r for r in providers.chart_json(df).collect()}
    assert (out["a"].trading_date, out["a"].observation_status, out["a"].adjusted_close) == (DAY, "missing_price", 1.5)
    assert out["b"].issue == out["c"].issue == "schema_change"
    act = providers.chart_actions(df.where("request_id = 'a'")).first()
    assert (act.event_type, act.event_date, act.numerator) == ("split", DAY, 2.0)
    page = spark.createDataFrame([("h", "<html>no</html>"), ("n", "No data"), ("k", '{"Note": "rate limit"}')], "request_id string, body string")
    assert [r.issue for r in providers.csv_text(page).collect() if r.request_id == "h"] == ["html_challenge"]
    assert "rate_limited" in [r.issue for r in providers.keyed_json(page).collect() if r.request_id == "k"]


def test_append_is_idempotent_and_conflicts(spark, tmp_path):
    table = f"{tmp_path.as_uri()}/t"
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    store.append(rows, table, ["k"], content=["v"])
    store.append(rows, table, ["k"], content=["v"])
    assert store.read(spark, table).count() == 2
    with pytest.raises(store.Conflict):
        store.append(spark.createDataFrame([(1, "z")], "k int, v string"), table, ["k"], content=["v"])
    members = datasets.frozen(rows.distinct(), ["k"], ["v"])
    assert store.freeze(members, tmp_path.as_uri()) == store.freeze(members, tmp_path.as_uri())
    assert datasets.replayed(members, members.where("k = 1"), ["k"]).first().status == "missing"


def test_raw_files_are_verified(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    files = providers.raw_files(spark, tmp_path.as_uri())
    row = files.first()
    told = [("ok", row.path, 3, row.sha256), ("size", row.path, 4, row.sha256), ("hash", row.path, 3, "0"), ("none", "x", 3, "0")]
    out = {r.id: r.raw_issue for r in providers.verified_raw(spark.createDataFrame(told, "id string, raw_path string, file_size bigint, sha256 string"), files).collect()}
    assert out == {"ok": None, "size": "raw_size_mismatch", "hash": "raw_hash_mismatch", "none": "raw_file_missing"}


def test_streams(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "1.json").write_text('{"id": "a", "v": 1}\n{"id": "b", "v": 2}\n')
    for run in range(2):
        (landing / f"again{run}.json").write_text('{"id": "a", "v": 1}\n')
        stream = cycle.landing(spark, str(landing), "id string, v int")
        cycle.append_once(stream, f"{tmp_path}/table", ["id"], f"{tmp_path}/point").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/table").count() == 2
    events = tmp_path / "events"
    events.mkdir()
    (events / "1.json").write_text('{"sample_id": "s1", "at": "2024-01-01T00:00:00Z", "kind": "expected"}\n{"sample_id": "s2", "at": "2024-01-01T00:00:00Z", "kind": "expected"}\n{"sample_id": "s2", "at": "2024-01-01T05:00:00Z", "kind": "received"}\n')
    schema = "sample_id string, at timestamp, kind string"
    query = cycle.delivery_deadlines(cycle.landing(spark, str(events), schema)).writeStream.format("memory").queryName("deadlines").option("checkpointLocation", f"{tmp_path}/point2").outputMode("append").start()
    query.processAllAvailable()
    (events / "2.json").write_text('{"sample_id": "s3", "at": "2024-01-09T00:00:00Z", "kind": "expected"}\n')
    query.processAllAvailable()
    (events / "3.json").write_text('{"sample_id": "s4", "at": "2024-01-09T01:00:00Z", "kind": "expected"}\n')
    query.processAllAvailable()
    # what comes after the answer, a block or another arrival, answers nothing, also after a restart
    (events / "4.json").write_text('{"sample_id": "s1", "at": "2024-01-09T01:00:00Z", "kind": "received"}\n{"sample_id": "s3", "at": "2024-01-09T02:00:00Z", "kind": "received"}\n')
    query.processAllAvailable()
    query.stop()
    late = []
    again = cycle.delivery_deadlines(cycle.landing(spark, str(events), schema)).writeStream.foreachBatch(lambda b, _: late.extend((r.sample_id, r.status) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/point2").outputMode("append").start()
    (events / "5.json").write_text('{"sample_id": "s3", "at": "2024-01-09T03:00:00Z", "kind": "received"}\n{"sample_id": "s1", "at": "2024-01-09T03:00:00Z", "kind": "received"}\n{"sample_id": "s5", "at": "2024-01-30T03:00:00Z", "kind": "received"}\n')
    again.processAllAvailable()
    (events / "6.json").write_text('{"sample_id": "s6", "at": "2024-01-30T04:00:00Z", "kind": "expected"}\n')
    again.processAllAvailable()
    again.stop()
    assert sorted(late) == [("s4", "blocked"), ("s5", "ready")]
    assert {(r.sample_id, r.status) for r in spark.sql("SELECT * FROM deadlines").collect()} == {("s1", "blocked"), ("s2", "ready"), ("s3", "ready")}


def test_fold_sizes_are_checked(spark):
    with pytest.raises(ValueError):
        datasets.fold_plans(spark.sql("SELECT current_date() AS decision_date"), kind="rolling", train=0, validation=1, test=1, step=1)


def test_reviewed_interval(spark):
    rows = spark.createDataFrame([(DAY,), (dt.date(2025, 1, 1),)], "trading_date date")
    out = ingest.reviewed(rows, {"start": "2024-01-01", "end": "2024-12-31", "price_semantics": "as_traded", "currency": "USD", "version": "r1"})
    assert [r.normalizer_version for r in out.collect()] == ["r1"]


def test_every_event_is_a_dated_action(spark, sf):
    from tidemark.plans.roles import role

    events = spark.read.parquet(f"{sf}/events.parquet")
    assert sorted(r.version_id for r in role(spark, sf, "dated_actions").collect()) == sorted(f"e{r.event_id}" for r in events.collect())
