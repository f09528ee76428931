"""Forward outcomes: open-to-open returns over sessions, a ledger of corporate actions, and statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import finite, left_open

HORIZONS = (1, 5, 20)
DOWN = -0.05
#: Days of a period by which holding intervals and actions are joined.
PERIOD = 64
#: Least double of full precision.
LEAST = 2.0**-1022


def endpoints(samples: DataFrame, plan: DataFrame, bars: DataFrame, series: list[str], horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """One row for each sample and horizon with entry and exit dates, times and opens (null if there is no bar)."""
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"exit_date_{h}").alias("exit_date"), F.col(f"exit_at_{h}").alias("exit_at"), F.col(f"exit_close_{h}").alias("exit_close")) for h in horizons])
    planned = samples.join(F.broadcast(plan), "decision_date").select(*samples.columns, "decision_at", "entry_date", "intended_entry_at", F.inline(rows))
    opens = bars.select(*series, "trading_date", "open")
    at_entry = opens.select(*series, F.col("trading_date").alias("entry_date"), F.col("open").alias("entry_open"))
    at_exit = opens.select(*series, F.col("trading_date").alias("exit_date"), F.col("open").alias("exit_open"))
    return planned.join(at_entry, [*series, "entry_date"], "left").join(at_exit, [*series, "exit_date"], "left")


def ledger(rows: DataFrame, actions: DataFrame, series: list[str], key: list[str], *, include_receivables: bool = True) -> DataFrame:
    """Adds quantity, paid, receivable, price_return, cash_return: shares and cash of one share bought at
    the entry open, through the actions of (entry, exit] by date, splits first, then id.

    Actions meet rows by series and period of PERIOD days; each row folds its own few actions in order. Where the product
    of the splits so far is beyond doubles, the quantity comes from the sum of their logarithms, which goes on: later
    splits may bring it back.
    """
    split = F.col("event_type") == "split"
    item = F.struct(
        F.col("ex_date"),
        F.when(split, 0).otherwise(1).alias("rank"),
        F.col("version_id"),
        F.when(split, F.col("numerator").cast("double") / F.col("denominator")).alias("ratio"),
        F.col("amount").cast("double").alias("amount"),
        F.col("payment_date"),
    )
    period = lambda date: F.floor(F.datediff(date, F.lit("1970-01-01").cast("date")) / PERIOD).cast("int")
    facts = actions.select(*series, period(F.col("ex_date")).alias("_period"), F.col("ex_date").alias("_ex"), item.alias("_item"))
    spans = rows.where("entry_date < exit_date").select(*key, *[c for c in series if c not in key], "entry_date", "exit_date", F.explode(F.sequence(period(F.col("entry_date")), period(F.col("exit_date")))).alias("_period"))
    own = spans.join(facts, [*series, "_period"]).where(left_open(F.col("entry_date"), F.col("exit_date"), F.col("_ex")))
    own = own.groupBy(*key).agg(F.array_sort(F.collect_list("_item")).alias("_items"))
    start = F.struct(F.lit(1.0).alias("quantity"), F.lit(0.0).alias("log"), F.lit(0.0).alias("paid"), F.lit(0.0).alias("receivable"))

    def step(acc: Column, x: Column) -> Column:
        cash = F.when(x["rank"] == 1, acc["quantity"] * x["amount"]).otherwise(0.0)
        log = acc["log"] + F.ln(x["ratio"])
        product = acc["quantity"] * x["ratio"]
        ordinary = lambda c: (c >= LEAST) & (c < float("inf"))
        settled = F.coalesce(x["payment_date"] < F.col("exit_date"), F.lit(False))
        return F.struct(
            F.when(x["rank"] != 0, acc["quantity"]).when(log.isNotNull() & ~(ordinary(acc["quantity"]) & ordinary(product)), F.exp(log)).otherwise(product).alias("quantity"),
            F.when(x["rank"] == 0, log).otherwise(acc["log"]).alias("log"),
            (acc["paid"] + F.when(settled, cash).otherwise(0.0)).alias("paid"),
            (acc["receivable"] + F.when(settled, 0.0).otherwise(cash)).alias("receivable"),
        )

    out = rows.join(own, key, "left").withColumn("_end", F.aggregate(F.coalesce("_items", F.array().cast(own.schema["_items"].dataType)), start, step))
    out = out.select(*rows.columns, F.size(F.coalesce("_items", F.array().cast(own.schema["_items"].dataType))).alias("n_actions"), "_end.quantity", "_end.paid", "_end.receivable")
    worth = F.col("quantity") * F.col("exit_open")
    cash = F.col("paid") + (F.col("receivable") if include_receivables else F.lit(0.0))
    return out.withColumns({"price_return": F.try_divide(worth, F.col("entry_open")) - 1, "cash_return": F.try_divide(worth + cash, F.col("entry_open")) - 1})


def flags(price_return: Column, horizon: Column) -> dict[str, Column]:
    """up_5 and down_5pct_5, for the five-session horizon alone."""
    five = horizon == 5
    return {"up_5": F.when(five, price_return > 0), "down_5pct_5": F.when(five, price_return <= DOWN)}


#: Guards in the order that decides a label's (status, reason). Columns that a frame lacks do not apply.
GUARDS = (
    ("calendar_missing", "blocked", "calendar_horizon_outside_provided_range"),
    ("order_invalid", "invalid", "invalid_decision_entry_exit_or_evaluation_order"),
    ("exit_after_simulation", "pending", "target_open_not_yet_reached"),
    ("exit_after_evaluation", "pending", "target_open_after_label_evaluation_asof"),
    ("close_only", "blocked", "opening_prices_unavailable_close_only"),
    ("mixed_series", "blocked", "mixed_label_series_or_duplicate_session"),
    ("currency_mismatch", "blocked", "label_currency_unknown_or_contract_mismatch"),
    ("conflict", "blocked", "unresolved_label_query_conflict"),
    ("state_unverified", "blocked", "security_trading_status_unverified"),
    ("state_mismatch", "blocked", "security_state_series_mismatch"),
    ("delisted", "blocked", "delisting_outcome_missing_or_unsupported"),
    ("halted", "blocked", "target_security_halted_no_price_substitution"),
    ("prelisting", "blocked", "security_prelisting_or_listing_unknown"),
    ("state_uncovered", "blocked", "security_status_interval_not_covered"),
    ("endpoint_waiting", "pending", "waiting_for_received_usable_open_price_within_delay"),
    ("endpoint_missing", "blocked", "past_endpoint_price_missing_or_collection_failure"),
    ("open_invalid", "invalid", "invalid_or_zero_open_price"),
    ("not_as_traded", "blocked", "as_traded_open_required_for_quantity_return"),
    ("coverage_missing", "blocked", "corporate_action_coverage_missing_or_not_available"),
    ("coverage_mismatch", "blocked", "corporate_action_coverage_series_mismatch"),
    ("action_mismatch", "blocked", "corporate_action_security_or_source_mismatch"),
    ("action_coverage", "blocked", "price_action_coverage_unverified"),
    ("ledger_blocked", "blocked", "corporate_action_ledger_blocked"),
    ("available_late", "pending", "label_processing_delay_not_completed"),
)


def clock_guards(evaluation_at: Column, simulation_at: Column, delay_hours: float = 48) -> dict[str, Column]:
    """The guards that clocks and endpoint prices decide, for rows of endpoints()."""
    if isinstance(delay_hours, bool) or not 0 <= delay_hours <= 168:
        raise ValueError("normal delay has to be 0 to 168 hours")
    gone = F.col("entry_open").isNull() | F.col("exit_open").isNull()
    waiting = evaluation_at <= F.col("exit_close") + F.make_dt_interval(secs=F.lit(delay_hours * 3600))
    return {
        "calendar_missing": F.col("exit_at").isNull() | F.col("intended_entry_at").isNull(),
        "order_invalid": ~((F.col("decision_at") < F.col("intended_entry_at")) & (F.col("intended_entry_at") < F.col("exit_at"))) | (evaluation_at > simulation_at),
        "exit_after_simulation": F.col("exit_at") > simulation_at,
        "exit_after_evaluation": F.col("exit_at") > evaluation_at,
        "endpoint_waiting": gone & waiting,
        "endpoint_missing": gone,
        "open_invalid": ~(finite(F.col("entry_open")) & finite(F.col("exit_open")) & (F.col("entry_open") > 0) & (F.col("exit_open") > 0)),
    }


def context_guards(evaluation_at: Column, *, currency: str, endpoint_conflicts_only: bool = False) -> dict[str, Column]:
    """The guards that a label's series, security, coverage and ledger decide.

    Columns: price_kind, n_series, currency, n_conflicts (n_endpoint_conflicts), symbol, state (struct of verified,
    symbol, listed_from, verified_through, delisted_on, halted_dates), price_semantics, coverage (struct of verified,
    symbol, available_at), n_foreign_actions, ledger_reason, label_available_at.
    """
    state, cover = F.col("state"), F.col("coverage")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    halted = F.array_contains(state["halted_dates"], F.col("entry_date")) | F.array_contains(state["halted_dates"], F.col("exit_date"))
    return {
        "close_only": F.col("price_kind") == "close_only",
        "mixed_series": F.col("n_series") > 1,
        "currency_mismatch": no(F.col("currency") == currency),
        "conflict": F.col("n_endpoint_conflicts" if endpoint_conflicts_only else "n_conflicts") > 0,
        "state_unverified": no(state["verified"]),
        "state_mismatch": no(state["symbol"] == F.col("symbol")),
        "delisted": state["delisted_on"] <= F.col("exit_date"),
        "halted": halted,
        "prelisting": no(state["listed_from"] <= F.col("entry_date")),
        "state_uncovered": no(state["verified_through"] >= F.col("exit_date")),
        "not_as_traded": no(F.col("price_semantics") == "as_traded"),
        "coverage_missing": no(cover["verified"] & (cover["available_at"] <= evaluation_at)),
        "coverage_mismatch": no(cover["symbol"] == F.col("symbol")),
        "action_mismatch": F.col("n_foreign_actions") > 0,
        "ledger_blocked": F.col("ledger_reason").isNotNull(),
        "available_late": F.col("label_available_at") > evaluation_at,
    }


def rule_guards() -> dict[str, tuple[Column, Column]]:
    """The guards of the rules by evidence (label_rules), each with its own reason: columns conflict, halt_reason, price_coverage_reason."""
    told = lambda c: (F.col(c).isNotNull(), F.col(c))
    return {"conflict": (F.col("conflict"), F.lit("unresolved_label_query_conflict")), "halted": told("halt_reason"), "action_coverage": told("price_coverage_reason")}


def with_status(rows: DataFrame, guards: dict[str, Column | tuple[Column, Column]]) -> DataFrame:
    """Adds status and reason by the first guard that holds; ready with a null reason if none does. A guard may bring a
    reason of its own beside its condition."""
    own = {name: guard if isinstance(guard, tuple) else (guard, None) for name, guard in guards.items()}
    verdict = F.coalesce(
        *[
            F.when(F.coalesce(own[name][0], F.lit(False)), F.struct(F.lit(status).alias("status"), (F.lit(reason) if own[name][1] is None else own[name][1]).alias("reason")))
            for name, status, reason in GUARDS
            if name in own
        ],
        F.struct(F.lit("ready").alias("status"), F.lit(None).cast("string").alias("reason")),
    )
    return rows.withColumn("_v", verdict).select(*rows.columns, "_v.status", "_v.reason")


def label_available_at(dependencies: list[Column], delay_seconds: float) -> Column:
    """The latest dependency plus the declared processing delay."""
    return F.greatest(*dependencies) + F.make_dt_interval(secs=F.lit(delay_seconds))


def halt_reason(intervals: Column, entry_at: Column, exit_at: Column, complete: Column) -> Column:
    """Why an endpoint is halted: intervals is array<struct<start_at, resumed_at>>, [start, resumed), open if
    resumed_at is null; the moment of resumption itself still blocks."""
    inside = lambda at: F.exists(intervals, lambda x: (x["start_at"] <= at) & (x["resumed_at"].isNull() | (at <= x["resumed_at"])))
    return F.when(~F.coalesce(complete, F.lit(False)), "halt_coverage_incomplete").when(inside(entry_at) | inside(exit_at), "target_security_halted_no_price_substitution")
