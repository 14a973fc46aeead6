"""Masking of values by a status variable."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.specs import dotted


def defined(status: Column, low: float | None = None, high: float | None = None, fill: float | None = None) -> Column:
    """Null for a status that is outside its valid range or its fill value."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (status >= low)
    if high is not None:
        ok = ok & (status <= high)
    if fill is not None:
        ok = ok & (status != fill)
    return F.when(ok, status)


def allowed(status: Column, rule: str | Iterable[float], over: Iterable[str] = ()) -> Column:
    """Whether a value with this status stays. Rules: ``all``, ``highest``, ``lowest`` (of the slice named by the columns ``over``),
    ``min:x``, ``max:x``, ``values=a,b,...`` or numbers. An undefined status never does, but under ``all``."""
    if not isinstance(rule, str):
        return F.coalesce(status.isin([float(v) for v in rule]), F.lit(False))
    name, _, rest = rule.replace("=", ":", 1).partition(":")
    if name == "all":
        return F.lit(True)
    if name in ("highest", "lowest"):
        w = Window.partitionBy(*over)
        return F.coalesce(status == (F.max(status).over(w) if name == "highest" else F.min(status).over(w)), F.lit(False))
    if name == "min":
        return F.coalesce(status >= float(rest), F.lit(False))
    if name == "max":
        return F.coalesce(status <= float(rest), F.lit(False))
    if name == "values":
        return F.coalesce(status.isin([float(v) for v in dotted(rest, float)]), F.lit(False))
    raise ValueError(f"unknown rule {rule!r}")


@dataclass(frozen=True)
class StatusRule:
    """One variable's rule: its status variable, what is allowed, the value in place of others (null if none), and the status's own file and kind."""

    variable: str
    status: str
    use: str
    fill: float | None = None
    file: str | None = None
    kind: str | None = None


def rules_of(text: str) -> list[StatusRule]:
    """The rules of a ``cdmQualityConfig`` document. Listed values go before ``use``; ValueError for what cannot be applied."""
    root = ET.fromstring(text)
    if root.tag != "cdmQualityConfig":
        raise ValueError("not a cdmQualityConfig document")
    out = []
    for v in root.findall("variable"):
        name, status = v.get("name", ""), v.findall("status_flag_variable")
        if len(status) != 1 or not status[0].get("name"):
            raise ValueError(f"{name}: no status variable")
        (s,) = status
        if s.get("type") and not s.get("file"):
            raise ValueError(f"{name}: the status has a type but no file")
        allowed_values = s.findall("allowed_values")
        listed, use = ((allowed_values[0].text or "").strip(), allowed_values[0].get("use", "")) if len(allowed_values) == 1 else ("", "")
        if not listed and not use:
            raise ValueError(f"{name}: neither use nor values given")
        fill = v.get("fillValue")
        out.append(StatusRule(name, s.get("name"), f"values={listed}" if listed else use, float(fill) if fill else None, s.get("file") or None, s.get("type") or None))
    return out


def mask(df: DataFrame, value: str, status: Column, rule: str | Iterable[float], over: Iterable[str] = (), fill: float | None = None) -> DataFrame:
    """Values without an allowed status become null, or ``fill``."""
    return df.withColumn(value, F.when(allowed(status, rule, over), F.col(value)).otherwise(F.lit(fill)))


def mask_by(df: DataFrame, value: str, status: DataFrame, name: str, rule: str | Iterable[float], dims: Iterable[str], fill: float | None = None, over: Iterable[str] = ("t",)) -> DataFrame:
    """As ``mask`` with the status in a table of fewer dimensions: it holds for all cells along the others. ``over``: dimensions of a slice."""
    dims, over = list(dims), set(over)
    judged = status.select(*dims, allowed(F.col(name), rule, [d for d in dims if d in over]).alias("_ok"))
    out = df.join(judged, dims, "left")
    return out.withColumn(value, F.when(F.col("_ok"), F.col(value)).otherwise(F.lit(fill))).drop("_ok")
