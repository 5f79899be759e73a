"""Configuration values: inline or in a file, checked where they are read."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping


def json_map(value: str) -> dict:
    """A JSON object given inline, or the file named after an @."""
    if value.startswith("@"):
        with open(value[1:], encoding="utf-8") as f:
            value = f.read()
    got = json.loads(value)
    if not isinstance(got, dict):
        raise ValueError("a JSON object is needed")
    return got


def mixture(value: str | Mapping[str, float], known: Iterable[str]) -> dict[str, float]:
    """Normalised weights; unknown sources, negative weights and no weight at all are errors."""
    raw = json_map(value) if isinstance(value, str) else dict(value)
    if extra := sorted(set(raw) - set(known)):
        raise ValueError(f"unknown sources: {extra}")
    w = {k: float(v) for k, v in raw.items()}
    if any(not 0 <= v < float("inf") for v in w.values()) or not sum(w.values()):
        raise ValueError("weights must be finite, not negative, and not all zero")
    return {k: v / sum(w.values()) for k, v in w.items()}


def pool_pin(value: str) -> dict[str, list[str]]:
    """Frozen file lists by source."""
    got = json_map(value)
    if "chunks" not in got:
        raise ValueError("a pin needs its chunks")
    return {k: list(v) for k, v in got["chunks"].items()}


def held_out_pin(value: str) -> list[str]:
    """Comma-separated families of six characters."""
    got = [x.strip() for x in value.split(",") if x.strip()]
    if bad := [x for x in got if len(x) != 6]:
        raise ValueError(f"not families: {bad}")
    return got


def batches(total: int, shard: int) -> list[tuple[int, int]]:
    """(first, count) of fixed shards over ``total`` positions."""
    return [(at, min(shard, total - at)) for at in range(0, total, shard)]


def known_sources(wanted: Iterable[str], known: Iterable[str]) -> list[str]:
    """``wanted`` in its order; an empty list, a repeated or an unknown source is an error."""
    names, have = list(wanted), set(known)
    if not names:
        raise ValueError("no sources")
    if extra := sorted(set(names) - have):
        raise ValueError(f"unknown sources: {extra}")
    if len(set(names)) < len(names):
        raise ValueError(f"repeated sources: {sorted({x for x in names if names.count(x) > 1})}")
    return names


def positive(**values: float) -> None:
    """All of the named numbers must be over 0 and finite."""
    if bad := {k: v for k, v in values.items() if not 0 < v < float("inf")}:
        raise ValueError(f"must be positive: {bad}")


def fractions(**values: float) -> None:
    """All of the named numbers must lie between 0 and 1."""
    if bad := {k: v for k, v in values.items() if not 0 <= v <= 1}:
        raise ValueError(f"must lie between 0 and 1: {bad}")


def dump_plan(budget: int, window: int, gamma: int, context: int, held: float, weights: str | Mapping[str, float], known: Iterable[str]) -> dict[str, int]:
    """Whole windows of each source for a budget of positions; every argument is checked first, nothing is guessed."""
    positive(budget=budget, window=window, gamma=gamma, context=context)
    fractions(held=held)
    if context + gamma >= window:
        raise ValueError(f"a window of {window} has no place with {context} before and {gamma} after it")
    shares = mixture(weights, known)
    total = budget // window
    if not total:
        raise ValueError(f"a budget of {budget} holds no window of {window}")
    plan = {k: int(total * w) for k, w in shares.items()}
    for k, _ in sorted(shares.items(), key=lambda x: (-(total * x[1] - plan[x[0]]), x[0]))[: total - sum(plan.values())]:
        plan[k] += 1
    return plan
