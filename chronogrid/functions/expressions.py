"""Equations as users write them: arithmetic, comparisons and listed functions over named values, and nothing else."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an equation may call, and its words.
FUNCTIONS = frozenset("abs cbrt ceil ceiling coalesce cos degrees exp factorial floor greatest if ifnull least ln log log10 log2 mod nullif nvl pmod pow power radians round sign signum sin sqrt tan".split())
WORDS = frozenset("and between case else end false is not null or then true when".split())
TOKEN = re.compile(r"\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![\w.]))|(?P<name>[A-Za-z_]\w*)|(?P<sign><=>|<=|>=|<>|!=|[-+*/%(),<>=]))")


def checked(equation: str, names: set[str] | frozenset[str]) -> Column:
    """The equation as a column. Any name, function or sign that is not listed is a ValueError; so nothing but arithmetic
    reaches the engine. Names are those of columns, and beat functions and words only where they don't stand before a bracket."""
    tokens, at = [], 0
    text = equation.rstrip()
    if "--" in text or "/*" in text or "->" in text:
        raise ValueError(f"comments and arrows can't stand in the equation {equation!r}")
    while at < len(text):
        met = TOKEN.match(text, at)
        if not met:
            raise ValueError(f"{text[at:].strip()[:20]!r} can't stand in the equation {equation!r}")
        tokens.append((met.lastgroup, met[met.lastgroup]))
        at = met.end()
    if not tokens:
        raise ValueError("the equation is empty")
    out, depth = [], 0
    for i, (kind, token) in enumerate(tokens):
        depth += (token == "(") - (token == ")")
        if depth < 0:
            raise ValueError(f"a bracket too many in {equation!r}")
        if kind == "name":
            called = i + 1 < len(tokens) and tokens[i + 1][1] == "("
            if token in names and not called:
                token = f"`{token}`"
            elif called and token.lower() in FUNCTIONS:
                token = token.lower()
            elif token.lower() in WORDS:
                token = token.lower()
            else:
                raise ValueError(f"{token} is {'no listed function' if called else 'not known'} in {equation!r}")
        out.append(token)
    if depth:
        raise ValueError(f"a bracket is missing in {equation!r}")
    return F.expr(" ".join(out))
