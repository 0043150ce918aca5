"""strptime / strftime formats compiled to Column expressions.

Parsing goes through one guarded regular expression per format and a cast of the rearranged
digits, never through a formatter that throws for every value it does not like: at scale most
of the 13 tries of a value fail, and an exception per try would dominate the run time.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats tried, in this order, after the one a field names.
DEFAULT_DATE_FORMATS = (
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%dT%H:%M:%S%z",
    "%Y-%m-%d",
    "%Y/%m/%d %H:%M:%S",
    "%Y/%m/%d",
    "%Y年%m月%d日 %H:%M:%S",
    "%Y年%m月%d日",
    "%b %d, %Y",
    "%B %d, %Y",
    "%B %Y",
    "%b %Y",
    "%Y-%m",
)
DEFAULT_FORMAT = "%Y-%m-%d %H:%M:%S"

_SHORT_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_LONG_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august",
                "september", "october", "november", "december")
_LONG_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

_INPUT = {
    "Y": r"(\d\d\d\d)",
    "y": r"(\d\d)",
    "m": r"(1[0-2]|0[1-9]|[1-9])",
    "d": r"(3[01]|[12]\d|0[1-9]|[1-9])",
    "H": r"(2[0-3]|[01]\d|\d)",
    "I": r"(1[0-2]|0[1-9]|[1-9])",
    "M": r"([0-5]\d|\d)",
    "S": r"(6[01]|[0-5]\d|\d)",
    "f": r"(\d{1,6})",
    "j": r"(36[0-6]|3[0-5]\d|[12]\d\d|0[1-9]\d|00[1-9]|[1-9]\d|0[1-9]|[1-9])",
    "p": r"(am|pm)",
    "b": "(" + "|".join(_SHORT_MONTHS) + ")",
    "B": "(" + "|".join(sorted(_LONG_MONTHS, key=len, reverse=True)) + ")",
    "a": "(" + "|".join(d[:3] for d in _LONG_DAYS) + ")",
    "A": "(" + "|".join(_LONG_DAYS) + ")",
    "z": r"([+-]\d\d:?[0-5]\d(?::?[0-5]\d(?:\.\d{1,6})?)?|Z)",
}
_PLAIN = set("YmdHMSfz")


def _compile_input(fmt: str) -> tuple[str, dict[str, int]] | None:
    """Pattern and group numbers, or None when strptime itself would refuse the format."""
    pattern, groups, i = [], {}, 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "%":
            code = fmt[i + 1: i + 2]
            i += 2
            if code == "%":
                pattern.append("%")
                continue
            if code not in _INPUT or code in groups:
                return None
            groups[code] = len(groups) + 1
            pattern.append(_INPUT[code])
        elif ch.isspace():
            while i < len(fmt) and fmt[i].isspace():
                i += 1
            pattern.append(r"\s+")
        else:
            pattern.append(re.sub(r"([\\.^$*+?{}\[\]|()])", r"\\\1", ch))
            i += 1
    return "(?i)^" + "".join(pattern) + r"\z", groups


def parse_one(text: Column, fmt: str) -> Column | None:
    """Timestamp without zone (an offset in the text keeps its wall clock), NULL if no match."""
    compiled = _compile_input(fmt)
    if compiled is None:
        return None
    pattern, g = compiled
    if set(g) <= _PLAIN:
        def ref(code, default):
            return f"${g[code]}" if code in g else default
        fraction = f".{ref('f', '')}" if "f" in g else ""
        layout = (f"{ref('Y', '1900')}-{ref('m', '1')}-{ref('d', '1')} "
                  f"{ref('H', '0')}:{ref('M', '0')}:{ref('S', '0')}{fraction}")
        canonical = F.regexp_replace(text, pattern, layout)
    else:
        def part(code, default):
            return F.regexp_extract(text, pattern, g[code]) if code in g else F.lit(default)
        if "y" in g and "Y" not in g:
            two = part("y", "0").cast("int")
            year = F.when(two < 69, two + 2000).otherwise(two + 1900).cast("string")
        else:
            year = part("Y", "1900")
        name = "b" if "b" in g else "B" if "B" in g else None
        if name:
            index = F.instr(F.lit("".join(_SHORT_MONTHS)), F.lower(F.substring(part(name, ""), 1, 3)))
            month = ((index + 2) / 3).cast("int").cast("string")
        else:
            month = part("m", "1")
        if "I" in g:
            hour = part("I", "0").cast("int") % 12
            if "p" in g:
                hour = hour + F.when(F.lower(part("p", "")) == "pm", 12).otherwise(0)
            hour = hour.cast("string")
        else:
            hour = part("H", "0")
        clock = F.concat(hour, F.lit(":"), part("M", "0"), F.lit(":"), part("S", "0"))
        if "f" in g:
            clock = F.concat(clock, F.lit("."), part("f", "0"))
        if "j" in g:
            start = F.concat(year, F.lit("-01-01")).try_cast("date")
            day = F.date_add(start, part("j", "1").cast("int") - 1).cast("string")
        else:
            day = F.concat_ws("-", year, month, part("d", "1"))
        canonical = F.concat(day, F.lit(" "), clock)
    matched = text.rlike(pattern)
    guard = _first_look(text, fmt)
    return F.when(matched if guard is None else guard & matched, canonical.try_cast("timestamp_ntz"))


def _first_look(text: Column, fmt: str) -> Column | None:
    """A comparison of one character that rules most texts out before the expression runs."""
    if fmt[:2] == "%Y" and len(fmt) > 2 and fmt[2] != "%" and not fmt[2].isspace():
        return F.substring(text, 5, 1).ilike(fmt[2]) if fmt[2].isalpha() else F.substring(text, 5, 1) == fmt[2]
    if fmt[:2] in ("%a", "%A", "%b", "%B"):
        return F.ascii(text) >= ord("A")
    return None


def parse_any(text: Column, formats: Sequence[str]) -> Column:
    tries = [c for c in (parse_one(text, f) for f in dict.fromkeys(formats)) if c is not None]
    return F.coalesce(*tries) if tries else F.lit(None).cast("timestamp_ntz")


_OUTPUT = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss",
    "f": "SSSSSS", "j": "DDD", "p": "a", "a": "EEE", "A": "EEEE", "b": "MMM", "h": "MMM", "B": "MMMM",
    "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy",
    "-m": "M", "-d": "d", "-H": "H", "-I": "h", "-M": "m", "-S": "s", "-j": "D",
}


def _iso_weekday(ts: Column) -> Column:
    return F.weekday(ts) + 1


_COMPUTED = {
    "u": lambda ts: _iso_weekday(ts).cast("string"),
    "w": lambda ts: (_iso_weekday(ts) % 7).cast("string"),
    "V": lambda ts: F.lpad(F.weekofyear(ts).cast("string"), 2, "0"),
    "e": lambda ts: F.lpad(F.dayofmonth(ts).cast("string"), 2, " "),
    "s": lambda ts: F.unix_seconds(ts.cast("timestamp")).cast("string"),
    "z": lambda ts: F.lit(""),
    "Z": lambda ts: F.lit(""),
}


def strftime(ts: Column, fmt: str) -> Column:
    """Format a timestamp by a strftime string; runs of directives share one formatter call."""
    pieces: list[Column] = []
    pattern, literal = "", ""

    def quoted():
        return "'" + literal.replace("'", "''") + "'" if literal else ""

    def flush():
        nonlocal pattern, literal
        if pattern:
            pieces.append(F.date_format(ts, pattern + quoted()))
        elif literal:
            pieces.append(F.lit(literal))
        pattern, literal = "", ""

    for match in re.finditer(r"%(-?[A-Za-z])|%%|[^%]+|%", fmt):
        token, code = match.group(0), match.group(1)
        if code in _OUTPUT:
            if not pattern and literal:
                flush()
            pattern, literal = pattern + quoted() + _OUTPUT[code], ""
        elif code in _COMPUTED:
            flush()
            pieces.append(_COMPUTED[code](ts))
        elif code:
            raise ValueError(f"unsupported output directive: %{code}")
        else:
            literal += "%" if token == "%%" else token
    flush()
    if not pieces:
        return F.lit("")
    return F.concat(*pieces) if len(pieces) > 1 else pieces[0]


def run_time(run_ts: dt.datetime | str | Column) -> Column:
    """One wall-clock instant per run: a literal, or a column for back-fills."""
    if isinstance(run_ts, Column):
        return run_ts.cast("timestamp_ntz")
    return F.lit(str(run_ts)).cast("timestamp_ntz")
