"""What needs a scanner rather than patterns: splitting LaTeX into rows, chains and conditions, and reading integrals."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from sumforge.functions import latex_reader as R

# Relations that separate the links of a chain, longest first.
RELATIONS = sorted(
    ["\\coloneqq", "\\coloneq", "\\eqqcolon", "\\eqcolon", "\\triangleq", "\\equiv", "\\defeq", "\\doteq", "\\approx", "\\leq", "\\le", "\\geq", "\\ge", "\\neq", "\\ne", "\\ll", "\\gg", "\\prec", "\\succ", "\\preceq", "\\succeq", "\\subset", "\\supset", "\\subseteq", "\\supseteq", "≈", "=", "<", ">", "≤", "≥", "≠", "≪", "≫"],
    key=len, reverse=True,
)
_ENVIRONMENT = re.compile(r"\\begin\{(align|equation|gather|multline|eqnarray)(\*?)\}(.*?)\\end\{\1\2\}", re.S)
_TRIG = "sinh|cosh|tanh|sin|cos|tan|sec|csc|cot"


def relations(s: str) -> Iterator[tuple[int, int]]:
    """Places of relations outside braces; an escaped or longer command is none."""
    depth = i = 0
    while i < len(s):
        c = s[i]
        if c == "\\" and i + 1 < len(s) and s[i + 1] in "{}":
            i += 2
            continue
        depth += (c == "{") - (c == "}")
        if depth == 0:
            for token in RELATIONS:
                if s.startswith(token, i) and not (token[0] == "\\" and s[i + len(token) : i + len(token) + 1].isalpha()):
                    yield i, i + len(token)
                    i += len(token) - 1
                    break
        i += 1


def chain(s: str) -> list[str]:
    """The links of a chain of relations."""
    out, at = [], 0
    for a, b in relations(s):
        out.append(s[at:a])
        at = b
    return [*out, s[at:]]


_SPACING = ("\\,", "\\;", "\\!", "\\:")


def clean(s: str) -> str:
    """One expression: sizes, tags and spacing commands off, bounds, logarithms, powers and arguments in standard form."""
    s = "".join(t for t in R.tokens(R.tags(R.limits_removed(R.sizes_unwrapped(R.differentials(s))))) if t not in _SPACING and t != "&")
    s = R.special_functions(R.integral_bounds(R.fractions(s)))
    s = re.sub(r"\s+", " ", s).strip().rstrip(".,;").strip()
    return re.sub(r"([)}]) ", r"\1", s)


def normalize(raw: str | None) -> list[dict]:
    """Records (part, accepted, leading, equivalents, conditions, reason) of one raw formula."""

    def rejected(reason: str) -> list[dict]:
        return [{"part": 0, "accepted": False, "leading": None, "equivalents": [], "conditions": None, "reason": reason}]

    if not raw:
        return rejected("empty")
    s = html.unescape(raw)
    if r"\begin{cases}" in s or (r"\left\{" in s and re.search(r"\\\\|<|>|\\le|\\ge", s)):
        return rejected("contains_piecewise_function")
    if re.search(r"\band\b|\\text\s*\{\s*or\s*\}|\bwhere\b.*=", s, re.I):
        return rejected("multiple_statements")
    if r"\Rightarrow" in s:
        return rejected("contains_rightarrow_implication")
    for _ in range(20):
        inner = _ENVIRONMENT.sub(lambda m: m.group(3), s.replace("$", ""))
        if inner == s:
            break
        s = inner
    rows: list[str] = []
    for row in re.split(r"\\\\(?:\[[^\]]*\])?|\n|\\cr(?![a-zA-Z])", s):
        row = row.replace("&", "").strip()
        if rows and row[:1] in ("+", "-"):
            rows[-1] += " " + row
        elif row:
            rows.append(row)
    if not rows:
        return rejected("empty_after_parsing")
    equations = [r for r in rows if "=" in r]
    parts = equations if len(rows) > 1 and len(equations) > 1 else [" ".join(rows)]
    out = []
    for k, part in enumerate(parts):
        main, condition = R.main_and_condition(part)
        links = [clean(x) for x in chain(main)]
        leading, rest = links[0], [x for x in links[1:] if x and x != links[0]]
        out.append({"part": k, "accepted": bool(leading), "leading": leading or None, "equivalents": rest if leading else [], "conditions": condition, "reason": None if leading else "empty_after_processing"})
    return out


class _Reader:
    """Reads the integrand of a LaTeX integral into an infix string."""

    def __init__(self, s: str):
        self.tokens = re.findall(r"\\[a-zA-Z]+|\d+|[a-zA-Z]|[-+*/^_{}()|\[\]]", s)
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def group(self) -> str:
        if self.peek() == "{":
            self.take()
            out = self.sum("}")
            if self.peek() != "}":
                raise ValueError("unbalanced braces")
            self.take()
            return out
        return self.atom()

    def sum(self, end: str) -> str:
        out = ""
        while self.peek() not in (end, ""):
            if self.peek() in "+-":
                out += self.take()
            out += self.product(end)
        return out or "0"

    def product(self, end: str) -> str:
        factors: list[str] = []
        while self.peek() not in ("", end, "+", "-"):
            t = self.peek()
            if t in ("*", "\\cdot", "\\times"):
                self.take()
            elif t == "/":
                self.take()
                factors[-1] += "/" + self.atom()
            else:
                factors.append(self.atom())
        return "*".join(factors)

    def atom(self) -> str:
        t = self.take()
        if t == "{":
            self.at -= 1
            out = "(" + self.group() + ")"
        elif t == "(":
            out = "(" + self.sum(")") + ")"
            if not self.peek():
                raise ValueError("unbalanced parentheses")
            self.take()
        elif t == "\\frac":
            out = f"(({self.group()})/({self.group()}))"
        elif t == "\\sqrt":
            root = "2"
            if self.peek() == "[":
                self.take()
                root = self.sum("]")
                self.take()
            out = f"(({self.group()})**(1/({root})))"
        elif t in ("\\pi", "\\alpha", "\\beta"):
            out = t[1:]
        elif t == "\\infty":
            out = "oo"
        elif re.fullmatch(rf"\\(?:arc)?(?:{_TRIG}|log|ln|exp)", t):
            name = t[1:].replace("arc", "a").replace("ln", "log")
            power = None
            if self.peek() == "^":
                self.take()
                power = self.group()
            out = f"{name}({self.atom().strip('()') if self.peek() != '(' else self.atom()[1:-1]})"
            out = f"{out}**({power})" if power else out
        elif t.isdigit() or t.isalpha():
            out = t
        else:
            raise ValueError(f"unexpected {t}")
        if self.peek() == "^":
            self.take()
            out = f"{out}**({self.group()})"
        return out


def integral(s: str) -> dict:
    r"""Integrand, variable and bounds of \int_{a}^{b} ... dx; error says what is missing."""
    none = {"integrand": None, "variable": None, "lower": None, "upper": None, "kind": None, "error": None}
    m = re.match(r"\\int(?![a-zA-Z])(?:_\{((?:[^{}]|\{[^{}]*\})*)\})?(?:\^\{((?:[^{}]|\{[^{}]*\})*)\})?(.*)$", clean(s), re.S)
    if not m:
        return none | {"error": "not_integral_object"}
    lower, upper, body = m.groups()
    d = re.search(r"(?<![a-zA-Z\\])d\s*([a-zA-Z])\s*$", body.strip()) or re.search(r"d\s*([a-zA-Z])\s*$", body.strip())
    if not d:
        return none | {"error": "no_differential"}
    try:
        read = lambda x: _Reader(x).sum("") if x else None
        inner = body.strip()[: d.start()]
        return {"integrand": read(inner) if inner.strip() else "1", "variable": d.group(1), "lower": read(lower), "upper": read(upper), "kind": "definite" if lower or upper else "indefinite", "error": None}
    except (ValueError, IndexError) as e:
        return none | {"error": str(e)}
    except RecursionError:
        return none | {"error": "nested_too_deeply"}


RECORD = "id string, part int, accepted boolean, leading string, equivalents array<string>, conditions string, reason string"
INTEGRAL = "id string, integrand string, variable string, lower string, upper string, kind string, error string"


def normalized(rows: DataFrame) -> DataFrame:
    """rows(id, latex): one or more records for each formula."""

    def run(batches):
        for pdf in batches:
            out = [(i, *r.values()) for i, s in zip(pdf["id"], pdf["latex"], strict=True) for r in normalize(s)]
            yield pd.DataFrame(out, columns=["id", "part", "accepted", "leading", "equivalents", "conditions", "reason"])

    return rows.select("id", "latex").mapInPandas(run, RECORD)


def integrals(rows: DataFrame) -> DataFrame:
    """rows(id, latex): what integral() reads; filter by the native predicates first."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(i, *integral(s).values()) for i, s in zip(pdf["id"], pdf["latex"], strict=True)], columns=[c.split()[0] for c in INTEGRAL.split(", ")])

    return rows.select("id", "latex").mapInPandas(run, INTEGRAL)
