"""Machine-readable contracts of features and labels, and checks of run settings before anything runs."""

from __future__ import annotations

import math
from datetime import datetime

from tidemark.operators import datasets, features, labels, models

#: Models of each task, and the least rows of each part of a scoped run.
TASKS = {"regression": ("zero", "mean", "ridge", "tree"), "classification": ("frequency", "logistic", "tree")}
LEAST = {"train": 100, "validation": 20, "test": 20}
MODES = ("strict", "research", "synthetic")
VERSIONS = ("3.0.1", "3.1.0")


def feature_contract(*, as_traded: bool = True) -> dict:
    change, volatility = ("close_price_change", "realized_log_price_change_volatility") if as_traded else ("close_return", "realized_log_return_volatility")
    names = [f"{change}_{n}" for n in features.CHANGES] + [f"{volatility}_{n}" for n in features.VOLATILITIES] + [f"close_to_ma_{n}" for n in features.MEANS] + ["open_gap", "intraday_high_low_ratio", "volume_to_prior20_mean"]
    return {"features": names, "lookback_sessions": features.LOOKBACK, "volatility": "sample deviation of log changes, not annualised", "gaps": "never filled", "volume_mean": "excludes the current session"}


def label_contract(version: str = VERSIONS[0]) -> dict:
    if version not in VERSIONS:
        raise ValueError(f"label version has to be one of {VERSIONS}")
    return {"version": version, "horizons": list(labels.HORIZONS), "entry": "open of the session after the decision", "exit": "open of the h-th session after the entry", "down_threshold": labels.DOWN, "guards": [reason for _, _, reason in labels.GUARDS], "conflicts": "endpoints only" if version == "3.1.0" else "any"}


def checked_features(names: list[str]) -> list[str]:
    allowed = {n for raw in (True, False) for n in feature_contract(as_traded=raw)["features"]}
    if not names or len(set(names)) != len(names) or (wrong := sorted(set(names) - allowed)):
        raise ValueError(f"features have to be different names of the contract, not {wrong if names else names}")
    return names


def checked_run(config: dict) -> dict:
    """A training run's settings; the first fault is an error."""
    unknown = set(config) - {"features", "model", "target", "horizon", "mode", "folds", "minimum"}
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    checked_features(config["features"])
    if config["model"] not in models.MODELS:
        raise ValueError(f"model has to be one of {models.MODELS}")
    if config["target"] not in ("price_return", "cash_total_return"):
        raise ValueError("target has to be price_return or cash_total_return")
    if config["horizon"] not in labels.HORIZONS:
        raise ValueError(f"horizon has to be one of {labels.HORIZONS}")
    if config["mode"] not in ("strict", "research", "synthetic"):
        raise ValueError("mode has to be strict, research or synthetic")
    return config


def whole(value: object, least: int = 0) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= least


def checked_scope(contract: object, series: dict) -> dict:
    """A scope contract for one series."""
    if not isinstance(contract, dict) or contract.get("version") != datasets.CONTRACT:
        raise ValueError(f"explicit scope contract {datasets.CONTRACT} required")
    if contract.get("scope") not in datasets.SCOPES:
        raise ValueError(f"scope has to be one of {datasets.SCOPES}")
    if contract["scope"] != "strict_history":
        if any(contract.get(k) != series[k] for k in ("source", "symbol")):
            raise ValueError("scope has to name its one source and symbol")
        if contract.get("market_representative") is not False:
            raise ValueError("limited scope has to say that it does not stand for the market")
    return contract


def checked_training(config: dict) -> dict:
    """All settings of a training run; the first fault is an error, nothing is filled in."""
    task, scope, split, least = config.get("task"), config.get("data_scope"), config.get("split") or {}, (config.get("split") or {}).get("minimum") or {}
    thresholds = [config.get(k) for k in ("regression_threshold", "classification_threshold")]
    finite = [isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) for v in thresholds]
    names = config.get("models") or []
    faults = [
        (config.get("mode") not in MODES, f"mode has to be one of {MODES}"),
        (task not in TASKS, f"task has to be one of {tuple(TASKS)}"),
        (config.get("target") not in ("price_return", "cash_total_return"), "target has to be price_return or cash_total_return"),
        (config.get("horizon") not in labels.HORIZONS or split.get("horizon") != config.get("horizon"), "run and split have to have one horizon of the contract"),
        (scope is not None and (scope not in datasets.SCOPES or config.get("mode") != ("strict" if scope == "strict_history" else "research")), "scope and mode do not fit"),
        (scope not in (None, "strict_history") and any(least.get(k, 0) < n for k, n in LEAST.items()), f"a scoped run needs at least {LEAST}"),
        (any(not whole(least.get(k, 1), 1) for k in LEAST), "least sizes of parts have to be 1 or more"),
        (not names or len(set(names)) != len(names) or bool(set(names) - set(TASKS.get(task, ()))), "models have to be different ones of the task"),
        (not whole(config.get("seed"), -(1 << 62)), "seed has to be a whole number"),
        (config.get("one_class") not in ("error", "constant"), "one_class has to be error or constant"),
        (config.get("model_selection") != "none", "models are not selected on tests"),
        (not all(finite), "thresholds have to be finite numbers"),
        (finite[1] and not 0 <= thresholds[1] <= 1, "the threshold of a probability has to be 0 to 1"),
    ]
    for wrong, why in faults:
        if wrong:
            raise ValueError(why)
    checked_features(config.get("features") or [])
    datetime.fromisoformat(config["evaluation_asof"])
    return config


def checked_operation(config: dict) -> dict:
    """Settings of an observed, forward operation on one security."""
    series, limits = config.get("series") or {}, config.get("limits") or {}
    checked_scope(config.get("scope_contract"), series)
    faults = [
        (config.get("input_domain", "market") != "market", "operation is on market data"),
        (config["scope_contract"]["scope"] != "forward_observed", "operation has to be forward_observed"),
        (config.get("cutoff_policy") not in ("explicit", "after_processing"), "cutoff_policy has to be explicit or after_processing"),
        (config.get("cutoff_policy") == "explicit" and not config.get("cutoff"), "an explicit cutoff is missing"),
        (config.get("horizons") != list(labels.HORIZONS), f"horizons have to be {list(labels.HORIZONS)}"),
        (any(series.get(k) != v for k, v in (("price_kind", "ohlcv"), ("price_semantics", "as_traded"), ("currency", "USD"))), "series has to be ohlcv as traded in USD"),
        (config.get("minimum") != LEAST, "the least sizes are fixed beforehand"),
        (not whole(config.get("freshness_sessions")) or config["freshness_sessions"] > 2, "freshness has to be 0 to 2 sessions"),
        (not (whole(limits.get("attempts"), 1) and limits["attempts"] <= 3), "attempts have to be 1 to 3"),
        (not (whole(limits.get("daily_budget"), 1) and limits["daily_budget"] <= 25), "the daily budget has to be 1 to 25"),
    ]
    for wrong, why in faults:
        if wrong:
            raise ValueError(why)
    checked_features(config.get("required_features") or [])
    return config
