"""Expressions: a guarded parser, a deterministic normal form, prefix and s-expression notation, tokens.

A tree is ("num", Fraction), ("sym", name), ("add" | "mul", ...), ("pow", base, exponent) or (function, ...). The normal
form is sound, not complete: equal canonical strings mean equal expressions, and not the other way round.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The token vocabulary, in order of its ids after PAD, SOE and EOE.
SPECIALS = ["PAD", "SOE", "EOE"]
CONSTANTS = ["0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "pi", "e", "INT+", "INT-"]
VARIABLES = ["x", "a", "b", "c"]
BINARY = ["add", "mul", "pow", "sub", "div", "rac"]
UNARY = ["inv", "pow2", "pow3", "pow4", "pow5", "sqrt", "exp", "log", "abs", "sin", "cos", "tan", "cot", "sec", "csc", "asin", "acos", "atan", "acot", "asec", "acsc", "sinh", "cosh", "tanh", "coth", "sech", "csch", "asinh", "acosh", "atanh", "acoth", "asech", "acsch"]
TOKENS = [*SPECIALS, *CONSTANTS, *VARIABLES, *BINARY, *UNARY, "Li", "zeta"]
ARITY = {**dict.fromkeys([*BINARY, "Li"], 2), **dict.fromkeys([*UNARY, "zeta"], 1)}
SEXP = {"add": "+", "mul": "*", "sub": "-", "div": "/"}
# Parameters that may occur, symbols that mark a failed parse, and constants.
PARAMETERS = {"a", "b", "c", "r", "s", "t", "u", "z", "n", "m", "alpha", "beta"}
SPURIOUS = {"dx", "dy", "dz", "dt", "du", "dv", "dw", "dr", "ds", "eta", "theta", "phi", "psi", "omega", "lambda", "mu", "nu", "xi", "rho", "sigma", "tau", "chi", "kappa", "epsilon", "iota", "omicron", "upsilon"}
MATH_CONSTANTS = {"pi", "E", "I", "e"}
KNOWN = {name: name for name in UNARY[6:]} | {"exp": "exp", "Abs": "abs", "polylog": "Li", "Li": "Li", "zeta": "zeta", "ln": "log"}
MAX_NODES, MAX_DIGITS, MAX_EXPONENT, MAX_BITS = 500, 15, 1000, 2**16
_TOKEN = re.compile(r"\s*(?:(\d+\.\d+|\d+)|([A-Za-z_]\w*)|(\*\*|[-+*/^(),]))")
ZERO, ONE = ("num", Fraction(0)), ("num", Fraction(1))


class Rejected(ValueError):
    pass


def num(x) -> tuple:
    return ("num", Fraction(x))


def parse(text: str, max_length: int = 200) -> tuple:
    """The normal form's tree of an infix string; Rejected for anything unsafe, too large or malformed."""
    if not text or len(text) > max_length or re.search(r"[^0-9A-Za-z_+\-*/^(). ,]", text) or "__" in text:
        raise Rejected("characters or length")
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise Rejected(f"unexpected {text[at]!r}")
        number, name, mark = m.groups()
        if number and len(number.replace(".", "")) > MAX_DIGITS:
            raise Rejected("number too long")
        tokens.append(("num", Fraction(number)) if number else ("name", name) if name else ("mark", "**" if mark == "^" else mark))
        at = m.end()
    if len(tokens) > MAX_NODES:
        raise Rejected("too many nodes")
    tokens.append(("mark", None))
    place = 0

    def take(mark=None):
        nonlocal place
        kind, value = tokens[place]
        if mark is not None and (kind, value) != ("mark", mark):
            raise Rejected(f"expected {mark}")
        place += 1
        return kind, value

    def peek():
        return tokens[place][1] if tokens[place][0] == "mark" else None

    def total():
        parts = [term()]
        while peek() in ("+", "-"):
            sign = take()[1]
            part = term()
            parts.append(part if sign == "+" else mul(num(-1), part))
        return add(*parts)

    def term():
        out = unary()
        while peek() in ("*", "/"):
            sign = take()[1]
            factor = unary()
            out = mul(out, factor) if sign == "*" else mul(out, power(factor, num(-1)))
        return out

    def unary():
        if peek() in ("+", "-"):
            sign = take()[1]
            out = unary()
            return out if sign == "+" else mul(num(-1), out)
        base = atom()
        if peek() == "**":
            take()
            return power(base, unary())
        return base

    def atom():
        kind, value = take()
        if kind == "num":
            return num(value)
        if kind == "name":
            if peek() != "(":
                return ("sym", "E" if value == "e" else value)
            take("(")
            args = [total()]
            while peek() == ",":
                take()
                args.append(total())
            take(")")
            return call(value, args)
        if value == "(":
            out = total()
            take(")")
            return out
        raise Rejected("malformed")

    out = total()
    if place != len(tokens) - 1:
        raise Rejected("malformed")
    return out


def call(name: str, args: list) -> tuple:
    if name == "sqrt" and len(args) == 1:
        return power(args[0], num(Fraction(1, 2)))
    op = KNOWN.get(name, name)
    if op == "exp" and args == [ZERO]:
        return ONE
    if op == "log" and args == [ONE]:
        return ZERO
    # odd and even functions: the sign of a negative product goes outside, or away
    if len(args) == 1 and args[0][0] in ("mul", "num") and _coefficient(args[0])[0] < 0:
        if op in ("sin", "tan", "asin", "atan", "sinh", "tanh", "asinh", "atanh"):
            return mul(num(-1), (op, mul(num(-1), args[0])))
        if op in ("cos", "cosh", "sec", "sech", "abs"):
            return (op, mul(num(-1), args[0]))
    return (op, *args)


def _coefficient(e: tuple) -> tuple[Fraction, tuple]:
    if e[0] == "num":
        return e[1], ONE
    if e[0] == "mul" and e[1][0] == "num":
        return e[1][1], e[2] if len(e) == 3 else ("mul", *e[2:])
    return Fraction(1), e


def degree(e: tuple) -> Fraction:
    if e[0] == "num" or e == ("sym", "pi") or e == ("sym", "E"):
        return Fraction(0)
    if e[0] == "sym":
        return Fraction(1)
    if e[0] == "pow":
        return degree(e[1]) * e[2][1] if e[2][0] == "num" else degree(e[1])
    if e[0] == "mul":
        return sum(map(degree, e[1:]), Fraction(0))
    return max(map(degree, e[1:])) if e[0] == "add" else Fraction(0)


def _order(e: tuple) -> tuple:
    return (-degree(e), show(e))


def add(*parts: tuple) -> tuple:
    terms: dict[tuple, Fraction] = {}
    for p in parts:
        for q in p[1:] if p[0] == "add" else (p,):
            c, rest = _coefficient(q)
            terms[rest] = terms.get(rest, Fraction(0)) + c
    constant = terms.pop(ONE, Fraction(0))
    out = sorted((mul(num(c), t) for t, c in terms.items() if c), key=_order)
    if constant:
        out.append(num(constant))
    return ZERO if not out else out[0] if len(out) == 1 else ("add", *out)


def mul(*parts: tuple) -> tuple:
    c, powers = Fraction(1), {}
    for p in parts:
        for q in p[1:] if p[0] == "mul" else (p,):
            if q[0] == "num":
                c *= q[1]
            else:
                base, e = (q[1], q[2]) if q[0] == "pow" else (q, ONE)
                powers[base] = add(powers[base], e) if base in powers else e
    if max(c.numerator.bit_length(), c.denominator.bit_length()) > MAX_BITS:
        raise Rejected("number too large")
    out = []
    for base, e in powers.items():
        p = power(base, e)
        if p[0] == "num":
            c *= p[1]
        elif p[0] == "mul":
            return mul(num(c), p, *out, *(power(b, x) for b, x in list(powers.items())[list(powers).index(base) + 1 :]))
        else:
            out.append(p)
    if not c:
        return ZERO
    if len(out) == 1 and out[0][0] == "add" and c != 1:
        return add(*(mul(num(c), t) for t in out[0][1:]))
    out.sort(key=show)
    full = [num(c), *out] if c != 1 or not out else out
    return full[0] if len(full) == 1 else ("mul", *full)


def power(base: tuple, e: tuple) -> tuple:
    if e == ZERO:
        return ONE
    if e == ONE or base == ONE:
        return base
    if base == ("sym", "E"):
        return ("exp", e)
    if e[0] == "num":
        n = e[1]
        if abs(n) > MAX_EXPONENT:
            raise Rejected("exponent too large")
        if base[0] == "num":
            if n.denominator == 1:
                if base[1] == 0 and n < 0:
                    raise Rejected("division by zero")
                if max(base[1].numerator.bit_length(), base[1].denominator.bit_length()) * abs(n) > MAX_BITS:
                    raise Rejected("result too large")
                return num(base[1] ** int(n))
            roots = [round(float(abs(k)) ** (1 / n.denominator)) if abs(k) < 10**12 else 0 for k in (base[1].numerator, base[1].denominator)]
            if base[1] >= 0 and roots[1] and roots[0] ** n.denominator == base[1].numerator and roots[1] ** n.denominator == base[1].denominator and abs(n.numerator) < 64:
                return num(Fraction(roots[0], roots[1]) ** n.numerator) if roots[0] or n > 0 else ("pow", base, e)
        if base[0] == "pow" and n.denominator == 1:
            return power(base[1], mul(base[2], e))
        if base[0] == "mul" and n.denominator == 1:
            return mul(*(power(f, e) for f in base[1:]))
    return ("pow", base, e)


def show(e: tuple) -> str:
    """The canonical string of a tree in normal form."""
    return _show(e)


@lru_cache(maxsize=10_000)  # a worker shows as many trees as there are rows
def _show(e: tuple) -> str:
    if e[0] == "num":
        return str(e[1])
    if e[0] == "sym":
        return e[1]
    if e[0] == "add":
        out = _show(e[1])
        for t in e[2:]:
            s = _show(t)
            out += " - " + s[1:] if s.startswith("-") else " + " + s
        return out
    if e[0] == "mul":
        c, rest = _coefficient(e)
        factors = rest[1:] if rest[0] == "mul" else (rest,) if rest != ONE else ()
        up = [f for f in factors if not _inverted(f)]
        down = [power(f[1], mul(num(-1), f[2])) for f in factors if _inverted(f)]
        top = ([str(abs(c.numerator))] if abs(c.numerator) != 1 or not up else []) + [_wrap(f) for f in up]
        low = ([str(c.denominator)] if c.denominator != 1 else []) + [_wrap(f) for f in down]
        return ("-" if c < 0 else "") + "*".join(top) + ("" if not low else "/" + low[0] if len(low) == 1 else "/(" + "*".join(low) + ")")
    if e[0] == "pow":
        if e[2] == num(Fraction(1, 2)):
            return f"sqrt({_show(e[1])})"
        if _inverted(e):
            return "1/" + _wrap(power(e[1], mul(num(-1), e[2])))
        base, x = _show(e[1]), _show(e[2])
        base = f"({base})" if e[1][0] in ("add", "mul", "pow") or base.startswith("-") or "/" in base else base
        return f"{base}**{x}" if e[2][0] in ("sym",) or (e[2][0] == "num" and x.isdigit()) else f"{base}**({x})"
    return f"{e[0]}({', '.join(map(_show, e[1:]))})"


def _inverted(f: tuple) -> bool:
    return f[0] == "pow" and _coefficient(f[2])[0] < 0


def _wrap(f: tuple) -> str:
    return f"({_show(f)})" if f[0] == "add" or (f[0] == "num" and f[1].denominator != 1) or (f[0] == "pow" and _inverted(f)) else _show(f)


def symbols(e: tuple) -> set[str]:
    return {e[1]} if e[0] == "sym" else set() if e[0] == "num" else set().union(*map(symbols, e[1:]))


def functions(e: tuple) -> set[str]:
    if e[0] in ("sym", "num"):
        return set()
    own = set() if e[0] in ("add", "mul", "pow") else {e[0]}
    return own.union(*map(functions, e[1:]))


def rename(e: tuple, mapping: dict[str, str]) -> tuple:
    """Simultaneous renaming of symbols."""
    if e[0] == "sym":
        return ("sym", mapping.get(e[1], e[1]))
    if e[0] == "num":
        return e
    args = [rename(x, mapping) for x in e[1:]]
    return add(*args) if e[0] == "add" else mul(*args) if e[0] == "mul" else power(*args) if e[0] == "pow" else call(e[0], args)


def canonicalize(text: str) -> tuple[str, str]:
    """(canonical string, first 12 digits of its SHA-256); what cannot be parsed is only trimmed."""
    try:
        out = show(parse(text, 1000))
    except (Rejected, RecursionError, ZeroDivisionError):
        out = text.strip()
    return out, _digest(out)


def _digest(canonical: str) -> str:
    return hashlib.sha256(canonical.encode()).hexdigest()[:12]


def variable_mapping(variable: str, names: set[str]) -> dict[str, str]:
    """The variable becomes x, the others in order a, b, c, then param0 and so on."""
    rest = sorted(names - {variable} - MATH_CONSTANTS)
    return {variable: "x"} | {n: "abc"[k] if k < 3 else f"param{k - 3}" for k, n in enumerate(rest)}


def normalize_query(text: str) -> str:
    """A query in canonical variables: the variable of integration is the last name that is no usual parameter."""
    e = parse(text)
    names = symbols(e) - MATH_CONSTANTS
    usual = sorted(names - {"a", "b", "c"})
    if any(len(n) > 1 for n in usual):
        raise Rejected("names of several letters")
    return show(rename(e, variable_mapping("x" if "x" in names else usual[-1] if usual else "x", names)))


def validate_symbols(text: str, variable: str) -> tuple[bool, str | None, list[str]]:
    """(valid, reason, parameters) by ordered rules."""
    try:
        e = parse(text, 1000)
    except (Rejected, RecursionError):
        return False, "failed to parse", []
    return _judged(e, variable)


def _judged(e: tuple, variable: str) -> tuple[bool, str | None, list[str]]:
    names, used = symbols(e), functions(e)
    params = names - {variable} - MATH_CONSTANTS
    rules = [
        ("I" in names, "imaginary unit"), ("zoo" in names, "complex infinity"), ("O" in used, "order"), (used & {"Min", "Max"}, "min or max"),
        (used & {"re", "im"}, "re or im"), ("Derivative" in used, "derivative"), (params & SPURIOUS, "spurious symbols"),
        (any(re.fullmatch(r"[a-zA-Z]+_\d+", p) for p in params), "subscripted variables"), (len(params) > 3, "too many params"),
        (params - PARAMETERS, "unknown params"), (used - set(ARITY), "disallowed functions"),
    ]
    reason = next((r for hit, r in rules if hit), None)
    return reason is None, reason, sorted(params) if reason is None else []


def _prefix_number(x: Fraction) -> list[str]:
    if x.denominator != 1:
        return ["div", *_prefix_number(Fraction(x.numerator)), *_prefix_number(Fraction(x.denominator))]
    n = int(x)
    return [str(n)] if 0 <= n <= 9 else ["INT+" if n > 0 else "INT-", *str(abs(n))]


def to_prefix(e: tuple) -> list[str]:
    """Prefix tokens; sums and products nest to the right, numbers first."""
    if e[0] == "num":
        return _prefix_number(e[1])
    if e[0] == "sym":
        return ["e" if e[1] == "E" else e[1]]
    if e[0] == "pow" and e[2] == num(Fraction(1, 2)):
        return ["sqrt", *to_prefix(e[1])]
    if e[0] == "mul" and len(e) == 3 and e[1] == num(-1):
        return ["sub", "0", *to_prefix(e[2])]
    if e[0] in ("add", "mul"):
        parts = sorted(e[1:], key=lambda x: x[0] != "num")
        out = to_prefix(parts[-1])
        for p in reversed(parts[:-1]):
            out = [e[0], *to_prefix(p), *out]
        return out
    return [e[0], *(t for a in e[1:] for t in to_prefix(a))]


def to_sexp(tree: tuple) -> str:
    """An s-expression of a tree, with numbers whole: (pow x (/ -1 2))."""
    if tree[0] == "num":
        return str(tree[1]) if tree[1].denominator == 1 else f"(/ {tree[1].numerator} {tree[1].denominator})"
    if tree[0] == "sym":
        return "e" if tree[1] == "E" else tree[1]
    if tree[0] in ("add", "mul"):
        parts = sorted(tree[1:], key=lambda x: x[0] != "num")
        out = to_sexp(parts[-1])
        for p in reversed(parts[:-1]):
            out = f"({SEXP[tree[0]]} {to_sexp(p)} {out})"
        return out
    return f"({tree[0]} {' '.join(map(to_sexp, tree[1:]))})"


def prefix_to_sexp(prefix: str) -> str:
    """An s-expression of prefix tokens; digits after a sign are read to the end of their run."""
    tokens: Iterator[str] = iter(prefix.split())
    ahead: list[str] = []

    def following() -> str:
        return ahead.pop() if ahead else next(tokens)

    def read() -> str:
        t = following()
        if t in ("INT+", "INT-"):
            digits = ""
            for d in tokens:
                if not d.isdigit():
                    ahead.append(d)
                    break
                digits += d
            if not digits:
                raise Rejected("sign without digits")
            return ("-" if t == "INT-" else "") + digits
        if t in ARITY:
            return f"({SEXP.get(t, t)} {' '.join(read() for _ in range(ARITY[t]))})"
        return t

    try:
        out = read()
    except (StopIteration, RuntimeError) as e:
        raise Rejected("prefix ends early") from e
    if ahead or next(tokens, None) is not None:
        raise Rejected("tokens left over")
    return out


def encode(prefix: list[str], max_length: int = 128) -> list[int]:
    """Ids with SOE and EOE, cut so that EOE stays, then padded."""
    ids = [1, *(TOKENS.index(t) for t in prefix)][: max_length - 1] + [2]
    return ids + [0] * (max_length - len(ids))


# Columns ---------------------------------------------------------------------------------------------------------------

CANONICAL = T.StructType().add("canonical", "string").add("hash", "string").add("prefix", "string").add("sexp", "string").add("valid", "boolean").add("reason", "string")


def _describe(text: str | None, variable: str = "x") -> tuple:
    if text is None:
        return (None,) * 6
    try:
        tree = parse(text, 1000)
    except (Rejected, RecursionError, ZeroDivisionError):
        return text.strip(), _digest(text.strip()), None, None, False, "failed to parse"
    try:
        canonical = show(tree)
    except (Rejected, RecursionError, ZeroDivisionError):
        canonical = text.strip()
    valid, reason, _ = _judged(tree, variable)
    try:
        return canonical, _digest(canonical), " ".join(to_prefix(tree)), to_sexp(tree), valid, reason
    except (Rejected, RecursionError):
        return canonical, _digest(canonical), None, None, valid, reason


@F.pandas_udf(CANONICAL)
def describe(texts: pd.Series) -> pd.DataFrame:
    """All that is known of an expression, in one pass over Arrow batches."""
    return pd.DataFrame([_describe(t) for t in texts], columns=CANONICAL.names)


@F.pandas_udf(T.StringType())
def canonical_query(texts: pd.Series) -> pd.Series:
    def one(t):
        try:
            return normalize_query(t)
        except (Rejected, RecursionError, TypeError):
            return None

    return texts.map(one)


@F.pandas_udf(T.StringType())
def sexp_of_prefix(prefixes: pd.Series) -> pd.Series:
    def one(p):
        try:
            return prefix_to_sexp(p)
        except (Rejected, AttributeError):
            return None

    return prefixes.map(one)


def encoded(tokens: Column, max_length: int = 128) -> Column:
    """Ids of an array of tokens with SOE and EOE, cut so that EOE stays, then padded; a null where a token is unknown."""
    ids = F.create_map(*(F.lit(x) for k, t in enumerate(TOKENS) for x in (t, k)))
    body = F.concat(F.array(F.lit(1)), F.transform(F.slice(tokens, 1, max_length - 2), lambda t: F.element_at(ids, t)), F.array(F.lit(2)))
    return F.concat(body, F.array_repeat(F.lit(0), max_length - F.size(body)))


def decoded(ids: Column) -> Column:
    """Tokens of ids up to EOE, padding and SOE left out, joined by spaces; an unknown id shows its number."""
    names = F.create_map(*(F.lit(x) for k, t in enumerate(TOKENS) for x in (k, t)))
    end = F.array_position(ids, 2)
    kept = F.filter(F.when(end > 0, F.slice(ids, 1, (end - 1).cast("int"))).otherwise(ids), lambda i: ~i.isin(0, 1))
    return F.array_join(F.transform(kept, lambda i: F.coalesce(F.try_element_at(names, i), F.concat(F.lit("<UNKNOWN_"), i.cast("string"), F.lit(">")))), " ")


def padding_mask(ids: Column) -> Column:
    return F.transform(ids, lambda i: i == 0)


def known_tokens(prefix: Column) -> Column:
    """Whether every token of a prefix string is in the vocabulary, apart from the three special ones."""
    return F.forall(F.split(F.trim(prefix), " +"), lambda t: t.isin(TOKENS[3:]))


def prefix_to_text(prefix: str) -> str:
    """Prefix tokens as a canonical infix expression."""
    items = prefix.split()

    def read(k: int) -> tuple[str, int]:
        if k >= len(items):
            raise Rejected("prefix ends early")
        t = items[k]
        if t in ("INT+", "INT-"):
            end = k + 1
            while end < len(items) and items[end].isdigit():
                end += 1
            if end == k + 1:
                raise Rejected("sign without digits")
            return f"({'-' if t == 'INT-' else ''}{''.join(items[k + 1 : end])})", end
        if t not in ARITY:
            return {"e": "E"}.get(t, t), k + 1
        parts, k = [], k + 1
        for _ in range(ARITY[t]):
            part, k = read(k)
            parts.append(part)
        if t in _SIGNS:
            return f"({parts[0]}{_SIGNS[t]}{parts[1]})", k
        if t == "rac":
            return f"({parts[0]}**(1/{parts[1]}))", k
        if t == "inv":
            return f"(1/{parts[0]})", k
        if t[:3] == "pow" and t[3:].isdigit():
            return f"({parts[0]}**{t[3:]})", k
        return f"{t}({','.join(parts)})", k

    text, end = read(0)
    if end < len(items):
        raise Rejected("tokens left over")
    return show(parse(text, 100_000))


_SIGNS = {"add": "+", "sub": "-", "mul": "*", "div": "/", "pow": "**"}


@F.pandas_udf(T.StringType())
def infix_of_prefix(prefixes: pd.Series) -> pd.Series:
    def one(p):
        try:
            return prefix_to_text(p) if p and all(t in TOKENS for t in p.split()) else None
        except (Rejected, RecursionError):
            return None

    return prefixes.map(one)
