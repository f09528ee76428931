"""Interval sets, symbol resolution and label rules against plain Python on random facts."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendar, datasets, diagnostics, ingest, intervals, label_rules, labels, pit, training
from tidemark.plans import contracts, pit_queries
from tidemark.plans.roles import role
from tidemark.sources import store

START = dt.date(2020, 1, 1)


def day(n):
    return None if n is None else START + dt.timedelta(days=n)


def inside(lo, hi, at):
    return lo <= at and (hi is None or at < hi)


def random_spans(rng, keys, n):
    return [(rng.choice(keys), lo := rng.randrange(300), None if rng.random() < 0.1 else lo + rng.choice([0, 1, 5, 40, 150])) for _ in range(n)]


@pytest.fixture(scope="module")
def spans():
    rng = random.Random(1)
    return random_spans(rng, "abc", 40) + [("d", 0, 10), ("d", 10, 20), ("e", 5, None)]


def frame(spark, spans):
    return spark.createDataFrame([(k, day(lo), day(hi)) for k, lo, hi in spans], "k string, lo date, hi date")


def test_intervals_at_points_unions_and_gaps(spark, spans):
    df = frame(spark, spans)
    points = spark.createDataFrame([(k, day(n)) for k in "abcdef" for n in range(0, 520, 3)], "k string, at date")
    want = {(k, day(n)) for k in "abcdef" for n in range(0, 520, 3) if any(k == s and inside(lo, hi, n) for s, lo, hi in spans)}
    assert {(r.k, r["at"]) for r in intervals.at_points(points, df, ["k"], "at", "lo", "hi").collect()} == want
    whole = [(r.k, r.lo, r.hi) for r in intervals.union(df, ["k"], "lo", "hi").collect()]
    covered = lambda k, n: any(s == k and inside(lo, hi, n) for s, lo, hi in spans)
    for k in "abcde":
        for n in range(520):
            assert sum(s == k and inside(lo, hi, day(n)) for s, lo, hi in whole) == covered(k, n)
    assert ("d", day(0), day(20)) in whole and ("e", day(5), None) in whole
    holes = [(r.k, r.lo, r.hi) for r in intervals.gaps(df, ["k"], "lo", "hi").collect()]
    for k, lo, hi in holes:
        assert lo < hi and not any(covered(k, n) for n in range((lo - START).days, (hi - START).days))
    targets = spark.createDataFrame([(k, day(n), day(n + 12)) for k in "abcdef" for n in range(0, 330, 7)], "k string, s date, e date")
    for r in intervals.contained(targets, df, ["k"], "s", "e", "lo", "hi").collect():
        n = (r.s - START).days
        assert r.covered == all(covered(r.k, m) for m in range(n, n + 13)), r


def test_where_owners_overlap(spark, spans):
    rng = random.Random(2)
    owned = [(k, rng.choice("xyz"), lo, hi) for k, lo, hi in spans]
    df = spark.createDataFrame([(k, o, day(lo), day(hi)) for k, o, lo, hi in owned], "k string, owner string, lo date, hi date")
    found = [(r.k, r.lo, r.hi) for r in intervals.several(df, ["k"], ["owner"], "lo", "hi").collect()]
    for k in "abcde":
        for n in range(520):
            many = len({o for s, o, lo, hi in owned if s == k and inside(lo, hi, n)}) > 1
            assert sum(s == k and inside(lo, hi, day(n)) for s, lo, hi in found) == many, (k, n)


def test_overlaps_of_very_many_owners_are_exact(spark):
    """Owners far down the numbering that are open alone, several times over, are no overlap."""
    lone = spark.range(200_000).selectExpr("'a' AS k", "lpad(cast(id AS string), 9, '0') AS owner", "date_add(DATE'1970-01-01', cast(2 * id % 20000 AS int)) AS lo", "date_add(DATE'1970-01-01', cast(2 * id % 20000 AS int)) AS hi")
    some = spark.createDataFrame([("a", "000199999", day(0), day(5))] * 7 + [("a", "000199998", day(5), day(6))] * 3 + [("a", "000199997", day(9), day(12)), ("a", "000199996", day(11), day(13))], "k string, owner string, lo date, hi date")
    wide = lone.withColumn("hi", F.date_add("lo", 1)).where("lo < DATE'2019-01-01'").dropDuplicates(["lo"])
    found = intervals.several(wide.unionByName(some).unionByName(lone.where("owner > '000199000'").withColumns({"lo": F.lit(day(30)), "hi": F.lit(day(30))})), ["k"], ["owner"], "lo", "hi").collect()
    assert [(r.lo, r.hi) for r in found] == [(day(11), day(12))]


def test_symbols_are_resolved_at_each_date(spark):
    rng = random.Random(3)
    at = [dt.datetime(2019, 1, d) for d in (1, 2)]
    facts = [(f"a{i}", rng.choice(["S", "T", "U", "V"]), rng.randrange(6), rng.choice(["X", "Y"]), lo, hi, rng.choice(["active"] * 5 + ["withdrawn"]), rng.choice(at)) for i, (_, lo, hi) in enumerate(random_spans(rng, "s", 60))]
    facts += [(f"b{i}", *f[1:6], rng.choice(["active", "withdrawn"]), rng.choice(at)) for i, f in enumerate(facts[:25])]
    df = spark.createDataFrame([(*f[:4], day(f[4]), day(f[5]), *f[6:]) for f in facts], "assertion_id string, symbol string, security int, exchange string, effective_from date, effective_to date, record_state string, order_at timestamp_ntz")
    rows = [(s, n) for s in range(7) for n in range(0, 480, 11)]
    for wanted in (None, ["S", "T"]):
        out = pit.resolve_symbols(spark.createDataFrame([(s, day(n)) for s, n in rows] + [(1, None)], "security int, trading_date date"), df, symbols=wanted)
        found = {(r.security, r.trading_date): (r.mapping_reason, r.symbols) for r in out.collect()}
        for s, n in rows:
            torn, clash, mine = False, False, set()
            for symbol in wanted or ["S", "T", "U", "V"]:
                groups, active = {}, set()
                for f in facts:
                    if f[1] == symbol and inside(f[4], f[5], n):
                        groups.setdefault(f[2:6], []).append(f)
                for group in groups.values():
                    states = {f[6] for f in group if f[7] == max(g[7] for g in group)}
                    torn |= len(states) > 1
                    if states == {"active"}:
                        active.add(group[0][2:4])
                if any(owner[0] == s for owner in active):
                    mine.add(symbol)
                    clash |= len(active) > 1
            want = "symbol_mapping_conflict" if torn or clash else None if mine else "no_eligible_effective_symbol_mapping"
            assert found[s, day(n)][0] == want, (s, n)
            if want is None:
                assert found[s, day(n)][1] == sorted(mine)
        assert found[1, None][0] == "no_eligible_effective_symbol_mapping"
    with pytest.raises(ValueError):
        pit.asked(rows, symbols=["S"])


@pytest.fixture
def whole_shuffles(spark):
    """Shuffles whose partitions are neither merged nor split, joined by sorting."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(old, ("false", "-1", "16")):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_previous_versions_take_one_shuffle_and_equal_plain_python(spark, whole_shuffles):
    rng = random.Random(5)
    rows = [(f"v{i}", rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 3, 4, 5]), rng.choice("xyz"), rng.random() < 0.7) for i in range(60)]
    versions = spark.createDataFrame(rows, "version_id string, k string, at int, value_hash string, ok boolean")
    before, ok = {}, {v: good for v, _, _, _, good in rows}
    for v, k, at, value, _ in rows:
        times = [t for _, c, t, _, _ in rows if k is not None and at is not None and c == k and t is not None and t < at]
        last = [(w, x) for w, c, t, x, _ in rows if times and c == k and t == max(times)]
        before[v] = min(w for w, _ in last) if last and len({x for _, x in last}) == 1 and last[0][1] != value else None
    found = pit.previous_version(versions, ["k"], "at")
    assert {r.version_id: r.previous_version_id for r in found.collect()} == before and any(before.values())
    assert plan_of(found).count("Exchange hashpartitioning") == 1
    hidden = {v: p if p and ok[p] else None for v, p in before.items() if ok[v]}
    for eligible in (F.col("ok"), versions.where("ok")):
        out = pit.eligible_lineage(versions, eligible, ["k"], "at")
        assert {r.version_id: r.previous_version_id for r in out.collect()} == hidden
    assert not re.search(r"hashpartitioning\(previous_version_id#\d+, 16\)", plan_of(out))  # one key for all without a previous version


def test_evidence_of_shared_content_is_dealt_out(spark, whole_shuffles):
    at = "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(id)"
    versions = spark.range(4000).selectExpr("cast(id AS string) AS version_id", "'other' AS raw_sha256", f"CASE WHEN id % 3 > 0 THEN {at} END AS published_at", f"CASE WHEN id % 5 = 0 THEN {at} END AS revised_at")
    versions = versions.unionByName(versions.where("version_id = '7'"))
    # the evidence of 4 is right, of 8 of another time, of 10 revised, of 11 unverified, of 12 of no time
    told = spark.range(4, 13).selectExpr("'other' AS version_raw_sha256", f"CASE WHEN id = 8 THEN {at} + INTERVAL '9' HOUR WHEN id <> 12 THEN {at} END AS published_at", f"CASE WHEN id = 10 THEN {at} END AS revised_at", "id <> 11 AS verified", "id").where("id IN (4, 8, 10, 11, 12)").drop("id")
    out = ingest.bound_evidence(versions, told)
    assert sorted(r.version_id for r in out.where("publication_bound").collect()) == ["10", "4"] and out.count() == 4000
    assert not re.search(r"hashpartitioning\(raw_sha256#\d+, 16\)", plan_of(out))


def test_exclusions_are_counted_without_the_content_of_excluded_versions(spark, sf, monkeypatch):
    seen, real = [], pit.judged
    monkeypatch.setattr(pit, "judged", lambda rows, *more: (seen.append(rows), real(rows, *more))[1])
    more = {"cutoff": pit_queries.cutoff(), "policy": "observed", "key": pit_queries.KEY, "session_scope": "regular"}
    found = pit.pit_query(role(spark, sf, "versions"), role(spark, sf, "links"), **more)
    whole = pit.exclusion_counts(real(found["reasoned"], pit_queries.KEY, "observed"))
    assert sorted(map(tuple, found["exclusions"].collect())) == sorted(map(tuple, whole.collect()))
    excluded = [rows.where("reason is not null") for rows in seen]
    assert any(rows.where("value_hash is not null or version_id is not null").isEmpty() and not rows.isEmpty() for rows in excluded)


def test_roots_of_long_chains(spark):
    chain = [(f"v{i}", f"v{i - 1}" if i % 37 else None) for i in range(100)]
    out = {r.version_id: (r.root_id, r.depth) for r in pit.roots(spark.createDataFrame(chain, "version_id string, previous_version_id string")).collect()}
    assert out == {f"v{i}": (f"v{i - i % 37}", i % 37) for i in range(100)}
    with pytest.raises(ValueError):
        pit.roots(spark.createDataFrame([("a", "b"), ("b", "a")], "version_id string, previous_version_id string"))


def brute_coverage(label, actions, reviewed, required, kind):
    series, entry, exit_ = label
    listed = [v for s, k, v in required if (s, k) == (series, kind)]
    if not listed or len({v for v in listed if v}) != len([v for v in listed if v]):
        return label_rules.FAULTS[kind][0]
    by_id = {v: (t, (eff if t == "split" else ex if t == "dividend" else eff or ex), ex) for s, v, t, eff, ex in actions if s == series}
    said = {v: (c, d) for s, v, c, d in reviewed if s == series}
    out = lambda d: d is not None and not entry < d <= exit_
    named = lambda v: {("split", "share_split"): "split", ("dividend", "ordinary_cash_dividend"): "dividend"}.get((by_id[v][0], said.get(v, (None,))[0]))
    listed = [v for v in listed if v]
    needed = [v for v in listed if not (v in by_id and out(by_id[v][1])) and not (v not in by_id and out(said.get(v, (None, None))[1]))]
    if any(v not in by_id for v in needed):
        return label_rules.FAULTS[kind][1]
    if any(named(v) != ("split" if kind == "price" else "dividend") for v in needed):
        return label_rules.FAULTS[kind][2]
    for v, (_, date, ex) in by_id.items():
        if kind == "price" and named(v) != "dividend" and not out(date) and v not in listed:
            return label_rules.FAULTS[kind][3]
        if kind == "cash" and named(v) == "dividend" and ex is not None and entry < ex <= exit_ and v not in listed:
            return label_rules.FAULTS[kind][3]
    return None


def test_coverage_reasons_equal_brute_force(spark):
    rng = random.Random(4)
    actions, reviewed, required = [], [], []
    names = [f"s{i}" for i in range(24)]
    for s in names:
        for i in range(rng.randint(0, 5)):
            kind = rng.choice(["split", "dividend", "dividend", "merger"])
            when = lambda: None if rng.random() < 0.15 else rng.randrange(0, 300)
            actions.append((s, f"{s}v{i}", kind, when(), when()))
            if rng.random() < 0.85:
                reviewed.append((s, f"{s}v{i}", {"split": "share_split", "dividend": rng.choice(["ordinary_cash_dividend"] * 4 + ["special"])}.get(kind, "merger"), when()))
            for k, fits in (("price", kind == "split"), ("cash", kind == "dividend")):
                if rng.random() < (0.9 if fits else 0.05):
                    required.append((s, k, f"{s}v{i}"))
        required += [(s, k, None) for k in ("price", "cash") if rng.random() < 0.9]
        if rng.random() < 0.2:
            required.append((s, "price", f"{s}none"))
            reviewed.append((s, f"{s}none", "share_split", rng.choice([None, 20, 250])))
        if rng.random() < 0.1:
            required += [(s, "cash", f"{s}twice")] * 2
    sample = [(s, a, a + rng.choice([1, 20, 90])) for s in [*names, "unknown"] for a in range(0, 280, 23)]
    rows = spark.createDataFrame([(i, s, day(a), day(b)) for i, (s, a, b) in enumerate(sample)], "id int, series string, entry_date date, exit_date date")
    dates = lambda rows, *at: [tuple(day(x) if i in at else x for i, x in enumerate(r)) for r in rows]
    acts = spark.createDataFrame(dates(actions, 3, 4), "series string, version_id string, event_type string, effective_date date, ex_date date")
    review = spark.createDataFrame(dates(reviewed, 3), "series string, version_id string, classification string, effective_date date")
    need = spark.createDataFrame(required, "series string, kind string, version_id string")
    found = label_rules.coverage_reasons(rows, acts, review, need, ["series"], ["id"]).collect()
    seen = set()
    for r in found:
        for kind in ("price", "cash"):
            want = brute_coverage(sample[r.id], actions, reviewed, required, kind)
            assert r[f"{kind}_coverage_reason"] == want, (sample[r.id], kind)
            seen.add(want)
    assert len(found) == len(sample) and len(seen) >= 8


def test_conflicts_that_matter(spark):
    rows = spark.createDataFrame([(i, "s", day(10), day(20), n) for i, n in enumerate([0, 1, 1, 1, 1, 2, 1])], "id int, series string, entry_date date, exit_date date, n_conflicts int")
    conflicts = spark.createDataFrame([(1, "c", day(10), ["x"]), (2, "c", day(15), ["x"]), (3, "c", None, ["cash", "cash2"]), (4, "c", day(10), ["away"]), (5, "c", day(15), ["x"]), (6, "c", None, [])], "id int, conflict_id string, date date, version_ids array<string>")
    review = spark.createDataFrame([("s", "cash", "ordinary_cash_dividend", None), ("s", "cash2", "ordinary_cash_dividend", None), ("s", "away", "share_split", day(30))], "series string, version_id string, classification string, effective_date date")
    ask = lambda **how: [i for i, hit in sorted((r.id, r.conflict) for r in label_rules.relevant_conflicts(rows, conflicts, review, ["series"], ["id"], **how).collect()) if hit]
    assert ask(endpoint_only=True) == [1, 3, 5, 6]  # 5 has a count that its conflicts do not account for
    assert ask() == [1, 2, 5, 6]
    assert ask(require_cash=True) == [1, 2, 3, 5, 6]
    assert ask(holding=False) == [1, 2, 4, 5, 6]


def test_halts_and_their_coverage(spark):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    known = [(s, t(0), t(50), True) for s in "abcdefg"] + [("a", t(50), t(90), True), ("h", t(0), t(90), False), ("b", t(60), t(90), True)]
    halts = [("c", t(5), t(10)), ("d", t(70), None), ("d", t(2), t(3)), ("e", t(5), t(5)), ("f", t(1), t(20)), ("g", t(8), t(20)), ("c", t(30), None)]
    rows = [("a", 10, 80, None), ("b", 10, 80, None), ("c", 10, 40, None), ("c", 12, 20, None), ("d", 10, 49, None), ("e", 10, 20, None), ("f", 10, 40, None), ("g", 1, 10, None), ("h", 1, 2, None), ("i", 1, 2, None), ("a", 1, 2, [day(0)]), ("a", 1, 90, None)]
    df = spark.createDataFrame([(i, s, t(a), t(b), h) for i, (s, a, b, h) in enumerate(rows)], "id int, series string, entry_at timestamp_ntz, exit_at timestamp_ntz, halted_dates array<date>")
    out = label_rules.halt_reasons(df, spark.createDataFrame(halts, "series string, start_at timestamp_ntz, resumed_at timestamp_ntz"), spark.createDataFrame(known, "series string, start_at timestamp_ntz, end_at timestamp_ntz, complete boolean"), ["series"])
    short = {None: None, label_rules.HALTED: "halted", label_rules.BOUNDARY: "edge", "security_halt_interval_not_covered": "gap", "security_halt_interval_coverage_unverified": "none", "security_halt_interval_invalid": "torn", "security_halt_date_only_evidence": "date"}
    found = {r.id: short[r.halt_reason] for r in out.collect()}
    assert [found[i] for i in range(len(rows))] == [None, "gap", "edge", None, None, "torn", "halted", "halted", "none", "none", "date", None]
    judged = labels.with_status(out.withColumns({"conflict": F.lit(False), "price_coverage_reason": F.when(F.col("id") == 0, "price_action_coverage_mismatch")}), labels.rule_guards())
    said = {r.id: (r.status, r.reason) for r in judged.collect()}
    assert said[0] == ("blocked", "price_action_coverage_mismatch") and said[2] == ("blocked", label_rules.BOUNDARY) and said[3] == ("ready", None)


def test_scoped_reasons(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    good = {"id": 0, "sample_status": "ready", "feature_ready_at": at(2), "decision_at": at(3), "intended_entry_at": at(4), "label_status": "ready", "label_available_at": at(9), "feature_domain": "market", "label_domain": "market", "learning_ready": True, "rights_available_at": None}
    contract = ("5.5", "forward_observed", "s", "A", False)
    good |= {"source": "s", "symbol": "A", "scope_contract": contract, "label_contract": contract, "identifier_verification": "verified", "scoped_input_eligible": True, "feature_policy": "observed", "label_policy": "observed", "feature_ready_basis": "actual_operational_record"}
    changes = [{}, {"sample_status": "blocked"}, {"feature_ready_at": at(4)}, {"decision_at": at(20), "intended_entry_at": at(21)}, {"label_status": "pending", "label_available_at": None}, {"label_domain": "synthetic"}, {"learning_ready": False}]
    changes += [{"label_contract": ("5.5", "forward_observed", "s", "B", False)}, {"identifier_verification": "temporary"}, {"scoped_input_eligible": None}, {"feature_policy": "historical_verified"}, {"feature_ready_basis": "simulated"}, {}, {}, {}, {}]
    struct = "struct<version:string,scope:string,source:string,symbol:string,market_representative:boolean>"
    schema = f"id int, sample_status string, feature_ready_at timestamp_ntz, decision_at timestamp_ntz, intended_entry_at timestamp_ntz, label_status string, label_available_at timestamp_ntz, feature_domain string, label_domain string, learning_ready boolean, rights_available_at timestamp_ntz, source string, symbol string, scope_contract {struct}, label_contract {struct}, identifier_verification string, scoped_input_eligible boolean, feature_policy string, label_policy string, feature_ready_basis string"
    rows = spark.createDataFrame([tuple((good | c | {"id": i}).values()) for i, c in enumerate(changes)], schema)
    right = lambda i, **over: tuple(({"id": i, "valid": True, "source": "s", "symbol": "A", "series_source": "s", "series_symbol": "A", "model_training_allowed": True, "policy": "observed", "published_at": at(1), "publication_date": None, "received_at": at(1), "usable_at": at(1), "verified": True, "content_verified": True} | over).values())
    rights = [right(i) for i in range(12)] + [right(13, valid=False), right(14, received_at=at(30), model_training_allowed=None, symbol="B"), right(15), right(15, verified=False)]
    rights = spark.createDataFrame(rights, "id int, valid boolean, source string, symbol string, series_source string, series_symbol string, model_training_allowed boolean, policy string, published_at timestamp_ntz, publication_date date, received_at timestamp_ntz, usable_at timestamp_ntz, verified boolean, content_verified boolean")
    asof = F.lit(at(10))
    ask = lambda scope: {r.id: r.reasons for r in datasets.scoped_learning_reasons(rows, rights, ["id"], asof, scope=scope).collect()}
    out = ask("forward_observed")
    assert out[0] == out[6] == [] and out[1] == ["feature_sample_not_ready"] and out[2] == ["feature_not_ready_by_decision"] and out[3] == ["feature_after_training_asof"]
    assert out[4] == ["label_not_available_at_training_asof", "label_not_ready"] and out[5] == ["synthetic_not_market_training"] and out[7] == ["explicit_matching_scope_contract_missing"]
    assert [out[i][0] for i in (8, 9, 10, 11)] == ["security_identity_unverified", "scoped_price_session_fields_unverified", "forward_scope_requires_observed_receipts", "actual_feature_processing_record_required"]
    assert out[12] == ["learning_rights_unconfirmed"] and out[13] == ["learning_rights_evidence_invalid", "learning_rights_unconfirmed"]
    assert out[14] == ["learning_rights_assertion_after_cutoff", "learning_rights_series_binding_missing", "model_training_permission_missing"] and out[15] == ["learning_rights_assertion_unverified"]
    strict = ask("strict_history")
    assert strict[6] == ["legacy_strict_pit_or_rights_unmet"] and strict[7] == strict[8] == [] and "learning_rights_series_binding_missing" not in strict[14]
    assert ask("fixed_security_research")[0] == ["explicit_matching_scope_contract_missing"]
    assert sorted(r.id for r in datasets.selected_at(rows, rights, ["id"], asof, scope="strict_history").collect()) == [0, 7, 8, 9, 10, 11]
    with pytest.raises(ValueError):
        datasets.scoped_learning_reasons(rows, rights, ["id"], asof, scope="all")


def test_explicit_folds_and_their_clocks(spark):
    fold = {"train": ("2020-01-01", "2020-03-31"), "validation": ("2020-04-01", "2020-04-30"), "test": ("2020-05-01", "2020-05-31")}
    rows = spark.createDataFrame([(day(n), dt.datetime.combine(day(n), dt.time(21)), dt.datetime.combine(day(n + 5), dt.time(14)), dt.datetime.combine(day(n + 6), dt.time())) for n in range(0, 170, 3)], "decision_date date, decision_at timestamp_ntz, intended_exit_at timestamp_ntz, label_available_at timestamp_ntz")
    good = datasets.explicit_folds(spark, [fold, fold | {"training_asof": "2020-04-02T21:00:00"}])
    assert datasets.asserted_folds(good, rows) is good and {r.fold for r in datasets.assign(rows, good).collect()} == {0, 1}
    for asof in ("2020-03-31T00:00:00", "2020-04-05T00:00:00"):
        with pytest.raises(ValueError, match="fold 1: training_asof"):
            datasets.asserted_folds(datasets.explicit_folds(spark, [fold, fold | {"training_asof": asof}]), rows)
    for wrong in ({"train": ("2020-03-31", "2020-01-01")}, {"train": ("2020-01-01", "2020-04-01")}, {"test": ("2020-04-30", "2020-05-31")}):
        with pytest.raises(ValueError):
            datasets.explicit_folds(spark, [fold | wrong])


def test_diagnosis_counts_keys_by_reason_area_and_overlap(spark):
    rows = [(1, ["publication_time_unknown", "learning_rights_unconfirmed"]), (1, ["publication_time_unknown"]), (2, ["learning_rights_unconfirmed", "legacy_strict_pit_or_rights_unmet"]), (3, []), (4, ["odd"]), (5, None)]
    out = {(r.measure, r.name): (r.n, r.needs is not None, r.code_can_resolve) for r in diagnostics.diagnosis(spark.createDataFrame(rows, "id int, reasons array<string>"), ["id"]).collect()}
    assert out["reason", "publication_time_unknown"] == (1, True, False) and out["reason", "learning_rights_unconfirmed"] == (2, True, False)
    assert out["reason", "legacy_strict_pit_or_rights_unmet"] == (1, True, True) and out["reason", "odd"] == (1, False, False)
    assert out["area", "rights"][0] == 2 and out["overlap", "publication_version & rights"][0] == 1 and out["overlap", "code_schema_connection & rights"][0] == 1 and len(out) == 9


def test_settings_are_checked():
    run = {"mode": "research", "task": "regression", "target": "price_return", "horizon": 5, "split": {"horizon": 5, "minimum": {"train": 100, "validation": 20, "test": 20}}, "data_scope": "forward_observed", "models": ["mean", "ridge"], "seed": 7}
    run |= {"one_class": "error", "model_selection": "none", "regression_threshold": 0.0, "classification_threshold": 0.5, "features": ["open_gap"], "evaluation_asof": "2024-01-01T00:00:00"}
    assert contracts.checked_training(run) is run
    wrong = [{"mode": "strict"}, {"task": "ranking"}, {"target": "x"}, {"horizon": 1}, {"data_scope": "all"}, {"split": {"horizon": 5, "minimum": {"train": 1}}}, {"models": ["mean", "mean"]}, {"models": ["logistic"]}, {"seed": True}, {"one_class": None}]
    wrong += [{"model_selection": "best"}, {"regression_threshold": float("nan")}, {"classification_threshold": 2}, {"features": ["x"]}, {"features": []}, {"evaluation_asof": "soon"}, {"data_scope": None, "split": {"horizon": 5, "minimum": {"train": 0}}}]
    for change in wrong:
        with pytest.raises(ValueError):
            contracts.checked_training(run | change)
    series = {"source": "s", "symbol": "A", "price_kind": "ohlcv", "price_semantics": "as_traded", "currency": "USD"}
    contract = {"version": "5.5", "scope": "forward_observed", "source": "s", "symbol": "A", "market_representative": False}
    operation = {"series": series, "scope_contract": contract, "cutoff_policy": "after_processing", "horizons": [1, 5, 20], "minimum": contracts.LEAST, "freshness_sessions": 1, "limits": {"attempts": 3, "daily_budget": 25}, "required_features": ["open_gap"]}
    assert contracts.checked_operation(operation) is operation
    for change in ({"scope_contract": contract | {"symbol": "B"}}, {"scope_contract": contract | {"market_representative": True}}, {"scope_contract": None}, {"cutoff_policy": "explicit"}, {"horizons": [1]}, {"series": series | {"currency": "EUR"}}, {"minimum": {}}, {"freshness_sessions": 3}, {"limits": {}}, {"required_features": []}, {"input_domain": "synthetic"}):
        with pytest.raises(ValueError):
            contracts.checked_operation(operation | change)


def test_runs_are_recorded_once(spark, tmp_path):
    found = [{"fold": 0, "task": "regression", "model": "mean", "parameters": {"value": 0.5}, "reason": None}, {"fold": 1, "task": "regression", "model": "mean", "parameters": None, "reason": "too few rows"}]
    record = lambda rows, **more: training.record_runs(spark, rows, f"{tmp_path.as_uri()}/runs", **({"dataset": "d", "settings": {"seed": 7}} | more))
    record(found)
    record(found)
    assert sorted((r.fold, r.status, r.reason) for r in store.read(spark, f"{tmp_path.as_uri()}/runs").collect()) == [(0, "OK", None), (1, "BLOCKED", "too few rows")]
    with pytest.raises(store.Conflict):
        record([found[0] | {"parameters": {"value": 0.6}}])
    record(found, settings={"seed": 8})
    assert store.read(spark, f"{tmp_path.as_uri()}/runs").count() == 4


def test_sessions_from_lists(spark):
    rows = calendar.session_table(spark, "2024-07-01", "2024-07-07", holidays=["2024-07-04"], early={"2024-07-03": "13:00"}, version="v").orderBy("trading_date").collect()
    assert [(r.trading_date.day, r.open_utc.hour, r.open_utc.minute, r.close_utc.hour) for r in rows] == [(1, 13, 30, 20), (2, 13, 30, 20), (3, 13, 30, 17), (5, 13, 30, 20)]
    assert calendar.session_table(spark, "2024-12-02", "2024-12-02", version="v").first().close_utc.hour == 21
