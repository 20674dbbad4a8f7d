"""A small predicate language compiled to a Column.

    run<1, 2, a, b>: a && (b || !c) stop

A mode (run, try or maybe), parameters, a Boolean expression, `stop`. Numbers queue up; each identifier that is new takes
the next number, or none. `!` binds before `&&`, `&&` before `||`; both group from the left; line ends don't count."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("run", "try", "maybe")
# The language's keywords and its token kinds, in order of precedence.
KEYWORDS = ("if", "else", "try", "for", "in", "run", "spawn", "stop", "maybe")
KINDS = (("NUMBER", r"[0-9]+(?:\.[0-9]+)?"), ("AND", r"&&"), ("OR", r"\|\|"), ("NOT", r"!"), ("LESS", r"<"), ("GREATER", r">"), ("PAREN", r"[()]"), ("COMMA", r","), ("COLON", r":"), ("ID", r"[A-Za-z]+"), ("NEWLINE", r"\n"), ("SKIP", r"[ \t\r]+"), ("MISMATCH", r"."))
_SCAN = re.compile("|".join(f"(?P<{n}>{p})" for n, p in KINDS))


class PredicateError(ValueError):
    """The program isn't of the language."""


def scan(code: str) -> list[tuple[str, str]]:
    """(kind, text) of the tokens; keywords have the kind KEYWORD, line ends and blanks go."""
    out = []
    for m in _SCAN.finditer(code):
        kind, text = m.lastgroup, m.group()
        if kind == "MISMATCH":
            raise PredicateError(f"unexpected {text!r}")
        if kind not in ("SKIP", "NEWLINE"):
            out.append(("KEYWORD" if kind == "ID" and text in KEYWORDS else kind, text))
    return out


def token_rows(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, pos, value): the tokens of programs in a column."""
    pattern = "|".join(p for n, p in KINDS if n not in ("SKIP", "NEWLINE", "MISMATCH"))
    return df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))).alias("pos", "value"))


def parse(code: str) -> dict:
    """{"mode", "params", "output"}: params maps identifiers to numbers or None; output is a tree of tuples ("id", name),
    ("not", x), ("and", x, y), ("or", x, y)."""
    left = scan(code)[::-1]

    def take(kind: str | None = None, text: str | None = None) -> str:
        if not left:
            raise PredicateError("the program ends early")
        if kind and left[-1][0] != kind or text and left[-1][1] != text:
            raise PredicateError(f"expected {text or kind}, found {left[-1][1]!r}")
        return left.pop()[1]

    def here(kind: str, text: str | None = None) -> bool:
        return bool(left) and left[-1][0] == kind and (text is None or left[-1][1] == text)

    mode = take("KEYWORD")
    if mode not in MODES:
        raise PredicateError(f"no mode {mode}")
    numbers: list[float] = []
    params: dict[str, float | None] = {}

    def name(text: str) -> tuple:
        if text not in params:
            params[text] = numbers.pop(0) if numbers else None
        return ("id", text)

    if here("LESS"):
        take("LESS")
        while not here("GREATER"):
            if here("NUMBER"):
                text = take()
                numbers.append(float(text) if "." in text else int(text))
            else:
                name(take("ID"))
            if not here("GREATER"):
                take("COMMA")
        take("GREATER")
    take("COLON")

    def primary() -> tuple:
        if here("NOT"):
            take()
            return ("not", primary())
        if here("PAREN", "("):
            take()
            inner = expression()
            take("PAREN", ")")
            return inner
        return name(take("ID"))

    def factor() -> tuple:
        out = primary()
        while here("AND"):
            take()
            out = ("and", out, primary())
        return out

    def expression() -> tuple:
        out = factor()
        while here("OR"):
            take()
            out = ("or", out, factor())
        return out

    tree = expression()
    take("KEYWORD", "stop")
    if left:
        raise PredicateError(f"unexpected {left[-1][1]!r} after stop")
    return {"mode": mode, "params": params, "output": tree}


def compiled(tree: tuple, bind: Callable[[str], Column]) -> Column:
    """The tree as a Column; bind gives an identifier's Column."""
    kind = tree[0]
    if kind == "id":
        return bind(tree[1])
    if kind == "not":
        return ~compiled(tree[1], bind)
    a, b = compiled(tree[1], bind), compiled(tree[2], bind)
    return a & b if kind == "and" else a | b


def where(df: DataFrame, code: str, bind: dict[str, Column] | None = None) -> DataFrame:
    """Rows for which a program holds; identifiers are Boolean columns, or what bind says. In mode `try` a program
    that can't be resolved keeps all rows; in `maybe` a null result counts as true."""
    program = parse(code)
    known = dict(bind or {})
    names = {n for n in program["params"] if n not in known}
    missing = names - set(df.columns)
    if missing:
        if program["mode"] == "try":
            return df
        raise PredicateError(f"no columns {sorted(missing)}")
    column = compiled(program["output"], lambda n: known.get(n, F.col(n)) if n in known else F.col(n))
    return df.where(F.coalesce(column, F.lit(True)) if program["mode"] == "maybe" else column)
