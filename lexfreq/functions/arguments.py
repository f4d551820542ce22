"""Query arguments are refused before any plan is built."""

from __future__ import annotations

from lexfreq import fixed_values as V


def level(value: int | None, name: str) -> None:
    low, high = V.LEVELS
    if value is not None and not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, not {value}")


def limit(value: int, bounds: tuple[int, int]) -> None:
    low, high = bounds
    if not low <= value <= high:
        raise ValueError(f"limit must be between {low} and {high}, not {value}")


def query(text: str) -> None:
    low, high = V.QUERY_LENGTH
    if not low <= len(text) <= high:
        raise ValueError(f"the query must have {low} to {high} characters")


def source_type(value: str, allowed=V.SOURCE_TYPES) -> None:
    if value != "all" and value not in allowed:
        raise ValueError(f"source_type must be 'all' or one of {', '.join(allowed)}")
