"""Python regular expressions restated for the JVM engine (on the driver, once per pattern)."""

from __future__ import annotations

import re

# Unicode classes and "\n is the only line end", as in Python's str patterns.
_FLAGS = "(?Ud)"


def java_pattern(pattern: str) -> str:
    p = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m.group(1).replace('_', '')}>", pattern)
    p = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<{m.group(1).replace('_', '')}>", p)
    p = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", p)
    return _FLAGS + p


def group_count(pattern: str) -> int:
    return re.compile(pattern).groups


def java_replacement(replacement: str, pattern: str) -> str:
    """``\\1``, ``\\g<1>`` and ``\\g<name>`` become ``$n``; a plain ``$`` is escaped."""
    names = re.compile(pattern).groupindex
    escapes = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "b": "\b"}
    out, i = [], 0
    while i < len(replacement):
        ch = replacement[i]
        if ch == "$":
            out.append("\\$")
        elif ch == "\\" and i + 1 < len(replacement):
            named = re.match(r"\\g<(\w+)>", replacement[i:])
            numbered = re.match(r"\\([1-9]\d?)", replacement[i:])
            if named or numbered:
                ref = (named or numbered).group(1)
                number = int(ref) if ref.isdigit() else names[ref]
                # "$1" followed by a digit would read as another group
                tail = replacement[i + len((named or numbered).group(0)):][:1]
                out.append(f"${number}" + ("\\" + tail if tail.isdigit() else ""))
                i += len((named or numbered).group(0)) + (1 if tail.isdigit() else 0)
                continue
            nxt = replacement[i + 1]
            out.append(escapes.get(nxt, "\\\\" if nxt == "\\" else "\\\\" + nxt))
            i += 1
        else:
            out.append(ch)
        i += 1
    return "".join(out)
