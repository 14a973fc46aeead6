"""Parsers of the small languages in which axes and times are asked for."""

from __future__ import annotations

import datetime as dt
import re


def _number(text: str) -> float:
    x = float(text)
    return int(x) if x == int(x) and "." not in text and "e" not in text.lower() else x


def dotted(text: str, parse=_number) -> list:
    """``a,b,...,z``: values from a to z in steps of b - a; z is added even if it is off the steps. Lists without dots stay as they are.

    >>> dotted("10,20,...,35")
    [10, 20, 30, 35]
    """
    parts = [p.strip() for p in text.split(",") if p.strip()]
    out: list = []
    k = 0
    while k < len(parts):
        if parts[k] != "...":
            out.append(parse(parts[k]))
            k += 1
            continue
        if len(out) < 2 or k + 1 >= len(parts):
            raise ValueError(f"dots need two values before and one after them: {text!r}")
        step, end = out[-1] - out[-2], parse(parts[k + 1])
        zero = step - step
        if step == zero or (end - out[-1] > zero) != (step > zero):
            raise ValueError(f"the steps of {text!r} don't lead to its end")
        start, n = out[-1], 1
        slack = step / 1e6 if isinstance(step, float) else zero
        while (start + n * step + slack < end) if step > zero else (start + n * step + slack > end):
            out.append(start + n * step)
            n += 1
        out.append(end)
        k += 2
    return out


def parameters(text: str) -> tuple[str, dict[str, str]]:
    """``values;key=value;...`` -> the values and the keys."""
    head, *rest = [p.strip() for p in text.split(";")]
    pairs = dict(p.split("=", 1) for p in rest if p)
    return head, {k.strip(): v.strip() for k, v in pairs.items()}


def _relative(head: str, first: float, last: float) -> list[float]:
    """Values like ``0,3,...,x,x+3``: multiples counted from an origin; x is the last one at or before ``last``."""
    parts = [p.strip() for p in head.split(",")]
    fixed = [float(p) for p in parts if p != "..." and "x" not in p]
    if len(fixed) < 2:
        raise ValueError(f"a relative list needs two numbers: {head!r}")
    step = fixed[1] - fixed[0]
    shifts = [float(p.replace(" ", "")[1:] or 0) for p in parts if p.startswith("x")]
    n = int((last - fixed[0]) / step)  # truncates towards zero
    x = fixed[0] + n * step
    out = [fixed[0] + k * step for k in range(n + 1)]
    return out + [x + s for s in shifts if s > 0] if not any(s < 0 for s in shifts) else [v for v in out if v <= x + min(shifts)]


def axis_values(text: str, start: float | None = None, end: float | None = None) -> list[float]:
    """An axis: a dotted list, or one relative to a start (``...;relativeStart=0``) that covers ``start`` to ``end`` of the data."""
    head, keys = parameters(text)
    if "relativeStart" not in keys:
        if "x" in head:
            raise ValueError(f"x without relativeStart: {text!r}")
        return [float(v) for v in dotted(head, float)]
    if start is None or end is None:
        raise ValueError("a relative axis needs the data's start and end")
    origin = float(keys["relativeStart"])
    return [origin + v for v in _relative(head, start - origin, end - origin)]


TIME_UNIT = re.compile(r"\s*(\w+?)s?\s+since\s+(.+?)\s*$", re.I)
SECONDS = {"second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600, "h": 3600, "hr": 3600, "day": 86400, "d": 86400, "week": 604800}


def parse_time(text: str) -> dt.datetime:
    t = dt.datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    return t.astimezone(dt.UTC).replace(tzinfo=None) if t.tzinfo else t


def time_unit(text: str) -> tuple[int, dt.datetime]:
    """``hours since 2000-01-01`` -> seconds per unit and the epoch."""
    m = TIME_UNIT.match(text)
    if not m or m[1].lower() not in SECONDS:
        raise ValueError(f"not a unit of time: {text!r}")
    return SECONDS[m[1].lower()], parse_time(m[2])


def time_values(text: str, start: dt.datetime | None = None, end: dt.datetime | None = None) -> list[dt.datetime]:
    """Times: an absolute dotted list, or ``0,3,...,x,x+3;relativeUnit=hours since 2000-01-01`` over the data's range."""
    head, keys = parameters(text)
    if "relativeUnit" not in keys:
        return dotted(head, parse_time)
    if start is None or end is None:
        raise ValueError("relative times need the data's start and end")
    seconds, epoch = time_unit(keys["relativeUnit"])
    first, last = ((t - epoch).total_seconds() / seconds for t in (start, end))
    parts = [float(p) for p in head.split(",") if p.strip() not in ("...", "") and "x" not in p]
    step = parts[1] - parts[0]
    base = int((first - parts[0]) / step) * step  # the data's first step, truncated towards zero
    moved = _relative(head, first - base, last - base)
    return [epoch + dt.timedelta(seconds=(base + v) * seconds) for v in moved]
