"""CSS selectors compiled to conditions on a node of ``html_nodes``.

Supported: ``tag``, ``*``, ``.class``, ``#id``, ``[attr]``, ``[attr=v]``, ``[attr^=v]``, ``[attr$=v]``,
``[attr*=v]``, ``[attr~=v]``, ``:first-child``, ``:last-child``, ``:only-child``, ``:nth-child(…)``,
``:first-of-type``, ``:nth-of-type(…)`` (a number, ``odd``, ``even`` or ``an+b``), ``:empty``, ``:not(…)`` of one
compound, descendant (blank), child (``>``), next sibling (``+``), later sibling (``~``) and comma lists. As with
CSS engines, ancestors and siblings may lie outside the searched subtree.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ingestkit.functions.html_nodes import below

_SIMPLE = re.compile(
    r"""\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*]?=)\s*(?P<q>["']?)(?P<val>.*?)(?P=q)\s*)?\]
    |:(?P<pseudo>[a-z-]+)(?:\(\s*(?P<arg>(?:[^()]|\([^()]*\))*?)\s*\))?
    |(?P<tag>\*|[a-zA-Z][\w-]*)""",
    re.VERBOSE,
)
_GROUPED = r"(?:\[[^\]]*\]|\((?:[^()]|\([^()]*\))*\))"


def _split_list(selector: str) -> list[str]:
    parts = re.findall(rf"(?:{_GROUPED}|[^,\[(])+", selector)
    return [p.strip() for p in parts if p.strip()]


def _split_chain(selector: str) -> list[tuple[str, str]]:
    """``nav > ul a`` → [("", nav), (">", ul), (" ", a)]"""
    tokens = re.findall(rf"\s*[>+~]\s*|\s+|(?:{_GROUPED}|[^\s>+~\[(])+", selector.strip())
    if "".join(tokens) != selector.strip():
        raise ValueError(f"unsupported selector: {selector}")
    chain, link = [], ""
    for token in tokens:
        if token.strip() in ("", ">", "+", "~"):
            link = token.strip() or " "
        else:
            chain.append((link, token))
            link = " "
    if not chain or chain[0][0] or tokens[-1].strip() in ("", ">", "+", "~"):
        raise ValueError(f"unsupported selector: {selector}")
    return chain


def _nth(position: Column, text: str) -> Column:
    """``3``, ``odd``, ``even``, ``2n+1``, ``-n+3`` on a 1-based position."""
    text = {"odd": "2n+1", "even": "2n"}.get(text, text).replace(" ", "")
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", text)
    if not m:
        raise ValueError(f"unsupported position: {text}")
    if m.group(3):
        return position == int(m.group(3))
    step = {"": 1, "+": 1, "-": -1}.get(m.group(1)) or int(m.group(1))
    offset = position - int(m.group(2) or 0)
    if step == 0:
        return offset == 0
    return (F.pmod(offset, F.lit(abs(step))) == 0) & (offset >= 0 if step > 0 else offset <= 0)


def _siblings(nodes: Column, node: Column) -> Column:
    return F.filter(below(nodes, F.get(nodes, node["parent"])), lambda n: n["parent"] == node["parent"])


def _pseudo(name: str, arg: str | None, nodes: Column, node: Column) -> Column:
    last = (node["parent"] < 0) | (F.get(nodes, node["parent"])["last"] == node["last"])
    if name == "first-child":
        return node["nth"] == 1
    if name == "last-child":
        return last
    if name == "only-child":
        return (node["nth"] == 1) & last
    if name == "nth-child" and arg:
        return _nth(node["nth"], arg)
    if name in ("first-of-type", "nth-of-type") and (arg or name == "first-of-type"):
        before = F.filter(_siblings(nodes, node), lambda n: (n["tag"] == node["tag"]) & (n["nth"] < node["nth"]))
        return _nth(F.coalesce(F.size(before), F.lit(0)) + 1, arg or "1")
    if name == "empty":
        return (node["last"] == node["idx"]) & (node["text_to"] == node["text_from"])
    if name == "not" and arg and len(_split_chain(arg)) == 1:
        return ~_compound(arg, nodes, node)
    raise ValueError(f"unsupported selector: :{name}")


def _compound(text: str, nodes: Column, node: Column) -> Column:
    tests: list[Column] = []
    end = 0
    for m in _SIMPLE.finditer(text):
        if m.start() != end:
            break
        end = m.end()
        g = m.groupdict()
        if g["tag"]:
            if g["tag"] != "*":
                tests.append(node["tag"] == g["tag"].lower())
        elif g["cls"]:
            tests.append(node["classes"].contains(f" {g['cls']} "))
        elif g["id"]:
            tests.append(_attr(node, "id") == g["id"])
        elif g["pseudo"]:
            tests.append(_pseudo(g["pseudo"], g["arg"], nodes, node))
        else:
            value, op, want = _attr(node, g["attr"].lower()), g["op"], g["val"]
            if op is None:
                tests.append(value.isNotNull())
            elif op == "=":
                tests.append(value == want)
            elif op == "~=":
                tests.append(F.concat(F.lit(" "), value, F.lit(" ")).contains(f" {want} "))
            elif not want:
                tests.append(F.lit(False))
            else:
                tests.append({"^=": value.startswith, "$=": value.endswith, "*=": value.contains}[op](want))
    if end != len(text):
        raise ValueError(f"unsupported selector: {text}")
    return F.coalesce(reduce(and_, tests), F.lit(False)) if tests else F.lit(True)


def _attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def _matches_chain(chain: list[tuple[str, str]], nodes: Column, node: Column) -> Column:
    link, compound = chain[-1]
    here = _compound(compound, nodes, node)
    if len(chain) == 1:
        return here
    rest = chain[:-1]
    if link == ">":
        return here & (node["parent"] >= 0) & _matches_chain(rest, nodes, F.get(nodes, node["parent"]))
    if link in ("+", "~"):
        def beside(n: Column) -> Column:
            place = n["nth"] == node["nth"] - 1 if link == "+" else n["nth"] < node["nth"]
            return place & _matches_chain(rest, nodes, n)
        return here & F.coalesce(F.exists(_siblings(nodes, node), beside), F.lit(False))
    return here & F.exists(node["above"], lambda i: _matches_chain(rest, nodes, F.get(nodes, i)))


def matches(selector: str, nodes: Column, node: Column) -> Column:
    options = [_matches_chain(_split_chain(s), nodes, node) for s in _split_list(selector)]
    if not options:
        raise ValueError("empty selector")
    return reduce(or_, options)


def select_all(selector: str, nodes: Column, scope: Column | None = None) -> Column:
    """Matching nodes in document order, within the whole page or within ``scope`` (a node array)."""
    return F.filter(nodes if scope is None else scope, lambda n: matches(selector, nodes, n))
