"""Argument checks, made before any plan is built."""

from __future__ import annotations


def check_range(name: str, value, low, high) -> None:
    if value is None or not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, got {value!r}")


def check_choice(name: str, value, allowed) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {sorted(allowed)}, got {value!r}")


def check_columns(df, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
