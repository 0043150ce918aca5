"""Template strings such as ``https://host/{region}?day={days_ago:1:%Y%m%d}`` as columns.

A template is a constant, so it is split once on the driver; what reaches the executors is a
``concat`` of literals, columns and formats of the run time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Mapping
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from ingestkit.functions.datetimes import run_time, strftime

_DAY = "%Y-%m-%d"
_NAME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")

#: Compiles a variable: (run time, text behind the colon) → text column.
Compiler = Callable[[Column, str], Column]


def _moved(shift: Callable[[Column, int], Column | int]) -> Compiler:
    """A day some way from the run's; the argument is a number and, behind another colon, a format."""
    def compiled(ts: Column, arg: str) -> Column:
        number, _, layout = arg.partition(":")
        days = shift(ts, int(number))
        return strftime(ts + F.make_interval(days=days if isinstance(days, Column) else F.lit(days)), layout or _DAY)
    return compiled


def _shown(layout: str, days: int = 0) -> Compiler:
    return lambda ts, arg: strftime(ts + F.make_interval(days=F.lit(days)) if days else ts, arg or layout)


_COMPILERS: dict[str, Compiler] = {
    "now": _shown("%Y-%m-%d %H:%M:%S"),
    "today": _shown(_DAY),
    "yesterday": _shown(_DAY, -1),
    "days_ago": _moved(lambda ts, n: -n),
    "weeks_ago": _moved(lambda ts, n: -7 * n),
    "this_week": _moved(lambda ts, n: F.lit(n - 1) - F.weekday(ts)),
    "last_week": _moved(lambda ts, n: F.lit(n - 8) - F.weekday(ts)),
    "timestamp": lambda ts, arg: F.unix_seconds(ts.cast("timestamp")).cast("string"),
    "timestamp_ms": lambda ts, arg: F.unix_millis(ts.cast("timestamp")).cast("string"),
}


def _scan(template: str) -> Iterator[tuple[str, str | None, str]]:
    """``(text, None, "")`` for plain text and ``(text, name, argument)`` for a variable, in order."""
    begin = at = 0
    while (at := template.find("{", at)) >= 0:
        end = template.find("}", at)
        if end < 0:
            break
        name, colon, arg = template[at + 1:end].partition(":")
        if name and set(name.lower()) <= _NAME and bool(colon) == bool(arg):
            if at > begin:
                yield template[begin:at], None, ""
            yield template[at:end + 1], name.lower(), arg
            begin = at = end + 1
        else:
            at += 1
    if begin < len(template):
        yield template[begin:], None, ""


def _value(name: str, arg: str, ts: Column, columns: Mapping[str, Column]) -> Column | None:
    if name in _COMPILERS:
        return _COMPILERS[name](ts, arg)
    if name == "task_name" and name not in columns:
        return F.lit("")
    return columns[name].cast("string") if name in columns else None


def render(template: str, run_ts: dt.datetime | str | Column, columns: Mapping[str, Column] | None = None) -> Column:
    """The rendered text. Names are lower-cased before lookup; an unknown one stays as written."""
    ts = run_time(run_ts)
    pieces: list[Column | str] = []
    for text, name, arg in _scan(template):
        value = _value(name, arg, ts, columns or {}) if name else None
        # a NULL variable must not blank the whole text
        pieces.append(text if value is None else F.coalesce(value, F.lit("None")))
    merged = [F.lit("".join(group)) if plain else piece
              for plain, group in groupby(pieces, key=lambda p: isinstance(p, str))
              for piece in ([None] if plain else group)] if pieces else [F.lit("")]
    return F.concat(*merged) if len(merged) > 1 else merged[0]


def has_variables(text: str) -> bool:
    return any(name for _, name, _ in _scan(text))
