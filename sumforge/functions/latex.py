"""LaTeX scalar functions and predicates as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sumforge.functions import latex_reader

# Reasons and patterns of the reject cascade, in order.
REJECTIONS = [
    (r"[KIJYfpqFPQ]_", "subscripted special function not parsed"),
    (r"(?U)\b[KESHfgh]\(", "unparsed function call"),
    (r"(?U)\b[KSHAfghE]\b", "unknown function symbol "),
    (r"(?U)\b[FGH]\(", "uppercase unknown function "),
    (r"(?U)\bo[\(\\]", "little o notation"),
    (r"[a-zA-Z]'", "derivative notation"),
    (r"[A-Z][a-z]", "uppercase + lowercase"),
    (r"[LXZTN][\+\-\*/\^\)]", "uppercase parameter variable"),
    (r"\([LXZTN]", "uppercase parameter variable after paren"),
    (r"\d+\.\d+", "decimal number (prefer fractions)"),
    (r"\\lim", "limit operator"),
    (r"\\prod", "product"),
    (r"matrix", "matrix expression"),
    (r"\\\{", "fractional part function"),
    (r"\[", "floor/ceiling function"),
]
# Fixed value: notations of polylogarithms.
POLYLOG = r"\\operatorname\{Li\}_|\\text\{Li\}_|Li_\{?\d+\}?"
# The patterns of display formulas, by pattern_index.
DISPLAY = [r"(?s)\$\$(.+?)\$\$", r"(?s)\\\[(.+?)\\\]", r"(?s)\\begin\{align\*?\}(.+?)\\end\{align\*?\}", r"(?s)\\begin\{equation\*?\}(.+?)\\end\{equation\*?\}"]
FUNCTIONS = ["sin", "cos", "tan", "sec", "csc", "cot", "sinh", "cosh", "tanh", "sech", "csch", "coth"]


def canonical_bounds(s: Column) -> Column:
    r"""Integral bounds with braces, the lower one first: \int^1_0 becomes \int_{0}^{1}."""
    return latex_reader.column(latex_reader.integral_bounds)(s)


def function_powers(s: Column) -> Column:
    r"""\sin^2 x becomes \sin(x)^{2}; arguments that hold commands stay."""
    return latex_reader.column(latex_reader.function_powers)(s)


def inverse_notation(s: Column) -> Column:
    r"""\sin^{-1} becomes \arcsin."""
    return latex_reader.column(latex_reader.inverse_notation)(s)


def logarithms(s: Column) -> Column:
    r"""\ln as \log, with powers behind and arguments in parentheses."""
    return latex_reader.column(latex_reader.logarithms)(s)


def function_arguments(s: Column) -> Column:
    r"""\sin x becomes \sin(x), \cos 2x becomes \cos(2x)."""
    return latex_reader.column(latex_reader.function_arguments)(s)


def differentials(s: Column) -> Column:
    r"""\mathrm{d}x, \text{dx}, \,dx and \dx as dx."""
    return latex_reader.column(latex_reader.differentials)(s)


def sanitized(s: Column) -> Column:
    """Without zero-width characters, no-break spaces as spaces."""
    return F.translate(s, "\u00a0\u200b\u200c\u200d\ufeff", " ")


def has_integral(s: Column) -> Column:
    return s.rlike(r"\\int(?![a-zA-Z])")


def multiple_integrals(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"\\int(?![a-zA-Z])")) > 1


def one_dimensional(s: Column) -> Column:
    """One integral over one variable: no multiple sign, and no line with two signs and two differentials behind them."""
    times = lambda line, mark: (F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))) / len(mark)

    def several(line: Column) -> Column:
        behind = F.substr(line, F.length(F.substring_index(line, "\\int", 2)) + 5)
        return (times(line, "\\oint") >= 2) | ((times(line, "\\int") >= 2) & (F.regexp_count(behind, F.lit("d[a-zA-Z]")) >= 2))

    multiple = s.contains("\\iint") | s.contains("\\iiint") | F.exists(F.split(s, "\n"), several)
    return ~multiple & has_integral(s) & s.rlike(r"d\s*[a-zA-Z]")


def piecewise(s: Column) -> Column:
    """Cases, matrices behind a brace, arrays with conditions in words (at the start of a text, or in any text behind & or a new row), rows behind a brace."""
    # Words of conditions.
    word = r"\\text\s*\{\s*(?:if\s|for\s|when\s|otherwise)|(?:&\s*|\\\\.*)\\text\s*\{.*(?:if|for|when|otherwise)"
    return s.contains(r"\begin{cases}") | (s.contains("matrix") & s.contains(r"\left\{")) | (s.contains(r"\begin{array}") & s.rlike("(?i)(?:" + word + ")")) | (s.contains(r"\left\{") & s.rlike(r"\\\\|<|>|\\le|\\ge"))


def multiple_statements(s: Column) -> Column:
    return s.rlike(r"(?i)\band\b|\\text\s*\{\s*or\s*\}|\bwhere\b.*=")


#: Commands and signs of relations other than equality; of implications.
INEQUALITIES, INEQUALITY_SIGNS = "leq|le|geq|ge|neq|ne|ll|gg|preceq|prec|succeq|succ|subseteq|subset|supseteq|supset", "<>≤≥≠≪≫"
IMPLICATIONS, IMPLICATION_SIGNS = "Rightarrow|Leftarrow|Leftrightarrow|implies|iff|Longrightarrow|Longleftarrow|Longleftrightarrow", "⇒⇐⇔"


def inequality(s: Column) -> Column:
    return s.rlike(rf"\\(?:{INEQUALITIES})(?![a-zA-Z])|[{INEQUALITY_SIGNS}]")


def matrix(s: Column) -> Column:
    return s.rlike(r"\\begin\{[pbv]?matrix\}")


def implication(s: Column) -> Column:
    return s.rlike(rf"\\(?:{IMPLICATIONS})(?![a-zA-Z])|[{IMPLICATION_SIGNS}]")


def single_letter_ij(s: Column) -> Column:
    r"""Whether a text is only a name: I or J, plain or calligraphic, then any scripts (one character or a group) and arguments."""
    group = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*+\}"
    return s.rlike(rf"^\s*(?:\\mathcal\{{[IJ]\}}|[IJ])(?:\s*[_^]\s*(?:{group}|[^{{}}\s])|\s*\([^()]*\))*+\s*$")


def reject_reason(s: Column) -> Column:
    """The first rule of the cascade that hits, or null; Li and polylogarithms pass the rule on mixed case."""
    exempt = (F.regexp_extract(s, "[A-Z][a-z]", 0) == "Li") | s.rlike(POLYLOG)
    hits = [F.when(s.rlike(p) & (~exempt if p == "[A-Z][a-z]" else F.lit(True)), F.lit("latex_rejected: " + reason)) for p, reason in REJECTIONS]
    return F.coalesce(*hits)


def family(s: Column) -> Column:
    """The functions that occur in a canonical integrand, sorted and joined; elementary if none does."""
    low = F.lower(s)
    arcs = [prefix + f for f in FUNCTIONS for prefix in ("", "a")]
    tests = [(f, [f + "("]) for f in [*arcs, "exp", "sqrt", "abs", "zeta", "re", "im"]] + [("log", ["log(", "ln("]), ("polylog", ["polylog(", "li("]), ("pow", ["**", "^"]), ("div", ["/"])]
    found = [F.when(reduce(lambda a, b: a | b, (low.contains(m) for m in marks)), F.lit(name)) for name, marks in tests]
    names = F.array_sort(F.array_compact(F.array(*found)))
    return F.when(F.size(names) == 0, "elementary").otherwise(F.array_join(names, ","))


def display_math(text: Column) -> Column:
    """array<struct<pattern_index, latex>>: display formulas of the four patterns in order, trimmed."""

    def found(k: int, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda m: F.struct(F.lit(k).alias("pattern_index"), F.trim(m).alias("latex")))

    return F.concat(*(found(k, p) for k, p in enumerate(DISPLAY)))
