"""Reads LaTeX as a list of tokens and brings it into standard form, one pass for each kind of rewriting.

A token is a command with its backslash, or a single character; joining the tokens gives the text back. Passes look at a
token and at what follows it, and never at patterns over the whole text, so each takes one walk.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DataType, StringType

_TOKEN = re.compile(r"\\[a-zA-Z]+|\\.|.", re.S)

# Names of functions and commands that the passes know.
TRIGONOMETRIC = ("sin", "cos", "tan", "sec", "csc", "cot")
HYPERBOLIC = ("sinh", "cosh", "tanh", "sech", "csch", "coth")
INVERTIBLE = (*TRIGONOMETRIC, "sinh", "cosh", "tanh")
POWERED = (*INVERTIBLE, "log", "ln")
SIZES = ("big", "Big", "bigg", "Bigg", "bigl", "bigr", "Bigl", "Bigr", "biggl", "biggr", "Biggl", "Biggr")
FONT_SIZES = ("tiny", "scriptsize", "footnotesize", "small", "normalsize", "large", "Large", "LARGE", "huge", "Huge")
TEXT_FUNCTIONS = ("Li", "Si", "Ci", "Ei", "sgn", "erf", "erfc", "erfi", "sech", "csch", "coth", "arccot", "arctanh", "arcsinh", "arccosh", "sinc", "agm", "Re", "Im")

Tokens = list[str]


def tokens(s: str) -> Tokens:
    return _TOKEN.findall(s)


class Walk:
    """A place in a list of tokens, where the part that is looked at ends, and what has been written so far."""

    def __init__(self, items: Tokens):
        self.items, self.at, self.end, self.out = items, 0, len(items), []
        self.closes, self.overs = {}, {}  # for each open brace its closing one, and the first \\over that it holds itself
        opened = []
        for k, t in enumerate(items if "{" in items else ()):
            if t == "{":
                opened.append(k)
            elif t == "}" and opened:
                self.closes[opened.pop()] = k
            elif t == "\\over" and opened:
                self.overs.setdefault(opened[-1], k)

    def __bool__(self) -> bool:
        return self.at < self.end

    def see(self, k: int | None = None) -> str:
        k = self.at if k is None else k
        return self.items[k] if k < self.end else ""

    def name(self) -> str:
        """The command at the place, without its backslash."""
        t = self.see()
        return t[1:] if len(t) > 1 else ""

    def past_space(self, k: int) -> int:
        while self.see(k).isspace():
            k += 1
        return k

    def past(self, k: int, fits: Callable[[str], bool]) -> int:
        while self.see(k) and fits(self.see(k)):
            k += 1
        return k

    def past_group(self, k: int) -> int | None:
        """The place behind the brace that closes the one at k."""
        close = self.closes.get(k, self.end)
        return close + 1 if close < self.end else None

    def lone_letter(self, k: int) -> bool:
        return letter(self.see(k)) and not word(self.see(k + 1))

    def copy(self) -> None:
        self.out.append(self.items[self.at])
        self.at += 1

    def write(self, to: int, *parts: str) -> None:
        self.out += parts
        self.at = to

    def text(self, a: int, b: int) -> str:
        return "".join(self.items[a:b])


def letter(t: str) -> bool:
    return len(t) == 1 and t.isascii() and t.isalpha()


def digit(t: str) -> bool:
    return len(t) == 1 and t.isascii() and t.isdigit()


def word(t: str) -> bool:
    return len(t) == 1 and (t.isalnum() or t == "_")


def _pass(step: Callable[[Walk], bool], *marks: str, heads: str = "") -> Callable[[str], str]:
    """A pass over a text: step writes what it rewrites and says so; everything else is copied.

    A text without any of marks has nothing for step, which begins at commands and at the characters in heads alone.
    """

    def whole(s: str) -> str:
        if not any(m in s for m in marks):
            return s
        walk = Walk(tokens(s))
        items, out, end = walk.items, walk.out, walk.end
        while walk.at < end:
            t = items[walk.at]
            if not ((len(t) > 1 or t in heads) and step(walk)):
                out.append(t)
                walk.at += 1
        return "".join(out)

    return whole


def _nested(step: Callable[[Walk], tuple | None], mark: str) -> Callable[[str], str]:
    """A pass whose rewritings hold parts that are rewritten as well, however deeply: no recursion.

    step returns None, or the place to go on at and what to write: strings, and (from, to) for a part of the tokens.
    A text without mark has nothing for it.
    """

    def whole(s: str) -> str:
        if mark not in s:
            return s
        walk = Walk(tokens(s))
        todo: list = [(0, walk.end)]
        while todo:
            job = todo.pop()
            if isinstance(job, str):
                walk.out.append(job)
                continue
            walk.at, walk.end = job
            while walk:
                found = step(walk)
                if found is not None:
                    todo += [(found[0], walk.end), *found[:0:-1]]
                    break
                walk.copy()
        return "".join(walk.out)

    return whole


def _power(w: Walk, k: int) -> int | None:
    """The place behind a power that begins with ^ at k: a group that is not empty, or digits."""
    if w.see(k) != "^":
        return None
    end = w.past_group(k + 1) if w.see(k + 1) == "{" else w.past(k + 1, digit)
    return end if end is not None and end > k + (3 if w.see(k + 1) == "{" else 1) else None


def _moved_power(w: Walk) -> bool:
    end = _power(w, w.at + 1) if w.name() in POWERED else None
    if end is None:
        return False
    head, power, k = w.see(), w.text(w.at + 2, end), w.past_space(end)
    if w.lone_letter(k):
        w.write(k + 1, head, "(", w.see(k), ")^{", power, "}")
        return True
    close = w.past(end, lambda t: t != ")" and len(t) == 1)
    if w.see(end) == "(" and w.see(close) == ")":  # an argument without commands
        w.write(close + 1, head, w.text(end, close + 1), "^{", power, "}")
        return True
    return False


def _inverse(w: Walk) -> bool:
    if w.name() not in INVERTIBLE:
        return False
    k = w.past_space(w.at + 1)
    if w.see(k) != "^":
        return False
    k = w.past_space(k + 1)
    close = {"{": "}", "(": ")"}.get(w.see(k))
    k = w.past_space(k + 1) if close else k
    if w.see(k) != "-" or w.see(k + 1) != "1":
        return False
    k += 2
    if close:
        k = w.past_space(k)
        if w.see(k) != close:
            return False
        k += 1
    elif word(w.see(k)):
        return False
    w.write(k, "\\arc" + w.name())
    return True


def _logarithm(w: Walk) -> bool:
    if w.name() not in ("ln", "log"):
        return False
    end = _power(w, w.at + 1)
    power = None if end is None else w.text(w.at + 2, end)
    k = w.past_space(w.at + 1 if end is None else end)
    last = w.past(k, digit)
    if last == k and power is not None and power.isdigit() and len(power) > 1:
        power, k, last = power[:-1], end - 1, end  # fixed behaviour, as in TeX, where a script without braces takes one digit: \log^32 is the cube of log 2
    if last == k and w.lone_letter(k):
        last = k + 1
    if last == k:
        w.write(w.at + 1, "\\log")
    else:
        w.write(last, "\\log(", w.text(k, last), ")", *(("^{", power, "}") if power is not None else ()))
    return True


def _argument(w: Walk) -> bool:
    if w.name() not in TRIGONOMETRIC + HYPERBOLIC:
        return False
    k = w.past_space(w.at + 1)
    last = w.past(k, digit)
    if last > k and letter(w.see(last)) or last == k and w.lone_letter(k):
        w.write(last + 1, w.see(), "(", w.text(k, last + 1), ")")
        return True
    return False


def _differential(w: Walk) -> bool:
    name = w.name()
    if name in ("textrm", "mathrm", "text"):
        k = w.past_space(w.at + 1)
        k = w.past_space(k + 1) if w.see(k) == "{" else len(w.items)
        if w.see(k) != "d":
            return False
        inner = w.past(k + 1, letter)
        close = w.past_space(inner)
        if w.see(close) != "}":
            return False
        if inner > k + 1:
            w.write(close + 1, w.text(k, inner))
            return True
        first = w.past_space(close + 1)
        if letter(w.see(first)):
            w.write(first, "d")
            return True
        return False
    if w.see() == "\\," and w.see(w.at + 1) == "d" and letter(w.see(w.at + 2)):
        w.write(w.at + 2, "d")
        return True
    if len(name) == 2 and name[0] == "d" and name[1] in "xyztuvsw" and not word(w.see(w.at + 1)):
        w.write(w.at + 1, name)
        return True
    return False


def _bound(w: Walk, k: int) -> tuple[str, int] | None:
    """A bound behind _ or ^: its text without braces and the place behind it."""
    if w.see(k) == "{":
        end = w.past_group(k)
        return None if end is None else (w.text(k + 1, end - 1), end)
    end = w.past(k, lambda t: len(t) == 1 and t not in "{}^_" and not t.isspace())
    return (w.text(k, end), end) if end > k else None


def _integral_bounds(w: Walk) -> bool:
    if w.name() != "int":
        return False
    found, k = {}, w.past_space(w.at + 1)
    while w.see(k) in ("_", "^") and w.see(k) not in found and (bound := _bound(w, k + 1)):
        found[w.see(k)], k = bound
    if not found:
        if w.see(k) in ("_", "^"):
            w.write(k, "\\int")
            return True
        return False
    if "_" in found:
        w.write(k, "\\int_{", found["_"], "}", *(("^{", found["^"], "}") if "^" in found else ()))
    else:
        w.write(w.past_space(w.at + 1), "\\int")
    return True


def _sizes(w: Walk) -> bool:
    name = w.name()
    if name not in ("left", "right", "middle", *SIZES):
        return False
    k = w.past_space(w.at + 1)
    if name in ("left", "right", "middle"):
        w.write(k + 1 if w.see(k) == "." else k)
    elif w.see(k) == "{" and (end := w.past_group(k)) is not None:
        w.write(end, w.text(k + 1, end - 1))
    else:
        w.write(k)
    return True


def _colour(w: Walk) -> bool:
    if w.name() not in ("color", "textcolor"):
        return False
    k = w.past_space(w.at + 1)
    end = w.past_group(k) if w.see(k) == "{" else None
    if w.name() == "textcolor" and end is not None and w.see(end) == "{" and (last := w.past_group(end)) is not None:
        w.write(last, w.text(end + 1, last - 1))
    else:
        w.write(k if end is None else end)
    return True


def _fraction(w: Walk) -> tuple | None:
    if w.name() not in ("frac", "dfrac", "tfrac", "cfrac"):
        return None
    parts, k = [], w.at + 1
    for _ in range(2):
        k = w.past_space(k)
        end = w.past_group(k) if w.see(k) == "{" else k + 1 if word(w.see(k)) or len(w.see(k)) > 1 and w.see(k)[1].isalpha() else None
        if end is None:
            return None if parts or w.name() == "frac" else (w.at + 1, "\\frac")
        parts.append((k + 1, end - 1) if w.see(k) == "{" else (k, end))
        k = end
    return k, "\\frac{", parts[0], "}{", parts[1], "}"


def _script(w: Walk) -> bool:
    """A command behind _ or ^, with the groups or digits that belong to it, gets braces."""
    if w.see() not in ("_", "^"):
        return False
    command = w.see(w.at + 1)
    if len(command) < 2 or not command[1].isalpha():
        return False
    wanted = 2 if command in ("\\frac", "\\dfrac", "\\tfrac") else 1 if command[1:] in ("sqrt", "operatorname", "mathrm", "text", *POWERED, "exp") else 0
    end, parts = w.at + 2, []
    for _ in range(wanted):
        k = w.past_space(end)
        last = w.past_group(k) if w.see(k) == "{" else w.past(k, digit)
        if last is None or last == k:
            return False
        parts.append(w.text(k, last) if w.see(k) == "{" else "{" + w.text(k, last) + "}")
        end = last
    w.write(end, w.see(), "{", command, *parts, "}")
    return True


def _over(w: Walk) -> tuple | None:
    end, over = w.past_group(w.at), w.overs.get(w.at)
    if end is None or over is None:
        return None

    def bare(a: int, b: int) -> tuple[int, int]:
        """The part without the space around it."""
        while a < b and w.items[a].isspace():
            a += 1
        while a < b and w.items[b - 1].isspace():
            b -= 1
        return a, b

    return end, "\\frac{", bare(w.at + 1, over), "}{", bare(over + 1, end - 1), "}"


def _artifact(w: Walk) -> bool:
    name, k = w.name(), w.past_space(w.at + 1)
    end = w.past_group(k) if w.see(k) == "{" else None
    if name in SIZES or name in FONT_SIZES:
        w.write(w.at + 1)
    elif name in ("phantom", "hphantom", "vphantom") and end is not None:
        w.write(end)
    elif name == "mathrm" and end is not None:
        w.write(end, w.text(k + 1, end - 1))
    elif name == "text" and end is not None and w.text(k + 1, end - 1).strip() in TEXT_FUNCTIONS:
        w.write(end, "\\operatorname{", w.text(k + 1, end - 1).strip(), "}")
    elif name == "cdot":
        w.write(w.at + 1, " \\cdot ")
    else:
        return False
    return True


def _text(w: Walk) -> bool:
    k = w.past_space(w.at + 1)
    end = w.past_group(k) if w.name() == "text" and w.see(k) == "{" else None
    if end is None:
        return False
    inner = w.text(k + 1, end - 1)
    words_ = " ".join(inner.split())
    w.write(end, "\\text{", " " if inner[:1].isspace() and words_ else "", words_, " " if inner[-1:].isspace() else "", "}")
    return True


def _dropped(*names: str) -> Callable[[Walk], bool]:
    def step(w: Walk) -> bool:
        if w.name() in names or w.see() in names:
            w.write(w.at + 1)
            return True
        return False

    return step


def _tag(w: Walk) -> bool:
    k = w.past_space(w.at + 1)
    end = w.past_group(k) if w.name() in ("tag", "label", "require") and w.see(k) == "{" else None
    if end is None:
        return False
    w.write(end)
    return True


_commands = lambda *names: tuple(f"\\{n}" for n in names)
function_powers, inverse_notation = _pass(_moved_power, "^"), _pass(_inverse, "-1")
logarithms, function_arguments = _pass(_logarithm, *_commands("ln", "log")), _pass(_argument, *_commands(*TRIGONOMETRIC))  # each hyperbolic name begins with one of these
differentials, integral_bounds = _pass(_differential, *_commands("text", "mathrm", ",", "d")), _pass(_integral_bounds, *_commands("int"))
sizes_unwrapped, colours_stripped = _pass(_sizes, *_commands("left", "right", "middle", "big", "Big")), _pass(_colour, *_commands("color", "textcolor"))
scripts, text_inside, tags = _pass(_script, "_\\", "^\\", heads="_^"), _pass(_text, *_commands("text")), _pass(_tag, *_commands("tag", "label", "require"))
artifacts = _pass(_artifact, *_commands("big", "Big", *FONT_SIZES, "phantom", "hphantom", "vphantom", "mathrm", "text", "cdot"))
fractions, over_to_frac = _nested(_fraction, "frac"), _nested(_over, "\\over")
limits_removed, alignment_removed = _pass(_dropped("limits", "nolimits", "displaystyle"), "limits", "displaystyle"), _pass(_dropped("&"), "&", heads="&")


def special_functions(s: str) -> str:
    """Logarithms, arguments, inverses and powers, in the order in which they build on each other."""
    return function_powers(inverse_notation(function_arguments(logarithms(s))))


def clean_side(s: str | None) -> str:
    """One side of a relation: alignment off, single spaces, none next to brackets, one closing mark off."""
    s = re.sub(r"\s+", " ", alignment_removed(s or "")).strip()
    s = text_inside(differentials(re.sub(r" ?([{}()]) ?", r"\1", s))).rstrip()
    if s[-1:] and s[-1] in ".;,:" and s[-2:-1] != "\\":
        s = s[:-1].rstrip()
    return s


def stripped(s: str) -> str:
    """The whole cascade: wrappers and colours until nothing changes, then fractions, scripts, functions and bounds."""
    before = None
    while before != s:
        before, s = s, re.sub(r"\s+", " ", colours_stripped(sizes_unwrapped(s)))
    for step in (tags, alignment_removed, over_to_frac, fractions, limits_removed, scripts, differentials, special_functions, integral_bounds, artifacts):
        s = step(s)
    return re.sub(r"\s+", " ", s).strip()


# Words that begin a condition, the first of them wins; relations behind a quad, in brackets, behind a comma;
# a main part before a comma has more characters than SHORT.
_MARKERS = ("for", "when", "if", "where", "provided", "given", "with")
_ASSIGNED = ("=", "<", ">", "≥", "≤", "\\in", "\\geq", "\\leq", "\\neq")
_ORDER = re.compile(r"[<>≤≥≠]|\\(?:le|leq|ge|geq|ne|neq)(?![a-zA-Z])")
_BRACKETED = re.compile(r"[<>≤≥]|\\text\s*\{|\\(?:forall|exists|in|notin|subset|supset|subseteq|supseteq|mathbb)(?![a-zA-Z])")
_VALUE = re.compile(r"[A-Z]\s*=\s*\d")
SHORT = 8


def main_and_condition(s: str) -> tuple[str, str | None]:
    """(main part, condition): a text marker, a quad before an assignment or relation, brackets at the end, a first comma."""
    items = tokens(s)
    walk = Walk(items)

    def cut(k: int) -> tuple[str, str]:
        return "".join(items[:k]).strip(), "".join(items[k:]).strip()

    marked: dict[str, int] = {}
    for k, t in enumerate(items):
        if t == "\\text":
            a = walk.past_space(k + 1)
            end = walk.past_group(a) if walk.see(a) == "{" else None
            if end is not None:
                marked.setdefault(walk.text(a + 1, end - 1).strip().lower(), k)
    for marker in _MARKERS:
        if marker in marked:
            return cut(marked[marker])
    quads = [k for k, t in enumerate(items) if t in ("\\quad", "\\qquad")]
    for k in quads:
        a = walk.past_space(k + 1)
        b = walk.past_space(a + 1)
        if items[k] == "\\quad" and a > k + 1 and letter(walk.see(a)) and walk.see(b) in _ASSIGNED:
            return cut(k)
    if s.rstrip().endswith(")"):
        opened = s.rstrip()[:-1].rfind("(")
        inside = s[opened:]
        if opened > 0 and ")" not in inside.rstrip()[:-1] and _BRACKETED.search(inside):
            return s[:opened].strip(), s[opened:].strip()
    for k in quads:
        if _ORDER.search(walk.text(k + 1, len(items))):
            return cut(k)
    first, comma, rest = s.partition(",")
    if comma and "=" in first and len(first.strip()) > SHORT and (_ORDER.search(rest) or _VALUE.search(rest)):
        return first.strip(), rest.strip()
    return s, None


def column(function: Callable, returns: DataType = StringType()) -> Callable[[Column | str], Column]:
    """A pass as a column function over Arrow batches; null stays null, and a text that is nested too deeply for the pass becomes null."""

    def passed(s: str | None):
        try:
            return None if s is None else function(s)
        except RecursionError:
            return None

    @pandas_udf(returns)
    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(passed)

    return batch
