"""Durations: fixed lengths, a month being 30 days and a year 365."""

from __future__ import annotations

import re

_SECOND = 1_000_000
_DAY = 86_400 * _SECOND
UNITS = {
    **dict.fromkeys(("us", "microsecond", "microseconds"), 1), **dict.fromkeys(("ms", "millisecond", "milliseconds"), 1000), **dict.fromkeys(("s", "sec", "secs", "second", "seconds"), _SECOND),
    **dict.fromkeys(("m", "min", "mins", "minute", "minutes"), 60 * _SECOND), **dict.fromkeys(("h", "hr", "hrs", "hour", "hours"), 3600 * _SECOND), **dict.fromkeys(("d", "day", "days"), _DAY),
    **dict.fromkeys(("w", "week", "weeks"), 7 * _DAY), **dict.fromkeys(("mon", "month", "months"), 30 * _DAY), **dict.fromkeys(("y", "year", "years"), 365 * _DAY),
}
_PART = re.compile(r"\s*([+-]?\d+(?:\.\d+)?)\s*([a-zA-Z]*)\s*")


def parse_interval(text: str) -> int:
    """Microseconds of '90', '15 minutes', '1 day 2 hours' or '2h30m'."""
    total, at = 0.0, 0
    while at < len(text) or not at:
        m = _PART.match(text, at)
        unit = m[2].lower() if m else ""
        if not m or (unit and unit not in UNITS):
            raise ValueError(f"not an interval: {text!r}")
        total += float(m[1]) * (UNITS[unit] if unit else _SECOND)
        at = m.end()
    return round(total)


def interval_sql(micros: int) -> str:
    sign, rest = "-" if micros < 0 else "", abs(micros)
    return f"INTERVAL '{sign}{rest // _SECOND}.{rest % _SECOND:06d}' SECOND"
