"""LaTeX queries: over documents, and over expressions that begin with a number from part, whose expected values are known.

CHECKS holds the golden tables by themselves, for tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sumforge.functions import expressions as E
from sumforge.functions import latex as L
from sumforge.functions import latex_reader as R
from sumforge.functions import latex_scan
from sumforge.functions.latex_reader import column
from sumforge.sources.tables import spread, sql_text, table

# Inputs of the golden tables and what must come of them.
GOLDEN = {
    "bounds_canonicalize": (L.canonical_bounds, {
        r"\int_0^1": r"\int_{0}^{1}", r"\int_{-1}^1": r"\int_{-1}^{1}", r"\int_0^{\frac{\pi}{2}}": r"\int_{0}^{\frac{\pi}{2}}", r"\int^1_0": r"\int_{0}^{1}",
        r"\int^{\infty}_0": r"\int_{0}^{\infty}", r"\int _0^1": r"\int_{0}^{1}", r"\int ^{\infty}_{0}": r"\int_{0}^{\infty}", r"\int_0 f(x) dx": r"\int_{0} f(x) dx",
        r"\int_0^1 f(x) dx + \int^2_1 g(x) dx": r"\int_{0}^{1} f(x) dx + \int_{1}^{2} g(x) dx", r"\int_a^b\frac{\sin(x)}{x}dx": r"\int_{a}^{b}\frac{\sin(x)}{x}dx",
        r"\int": r"\int", r"\int_{}^{}": r"\int_{}^{}", r"\int f(x) dx": r"\int f(x) dx", "x^2 + y^2 = 1": "x^2 + y^2 = 1", "": "",
    }),
    "function_powers": (L.function_powers, {
        r"\sin^2 x": r"\sin(x)^{2}", r"\cos^3(x + y)": r"\cos(x + y)^{3}", r"\sin^{2}(x)": r"\sin(x)^{{2}}", r"\cos^2(e^x)": r"\cos(e^x)^{2}",
        r"\log^2 x \cdot \sin^3 y": r"\log(x)^{2} \cdot \sin(y)^{3}", r"\ln^3(\sin(x))": r"\ln^3(\sin(x))", r"\sin^2(\frac{x}{2})": r"\sin^2(\frac{x}{2})",
        r"\sin^2": r"\sin^2", r"\log^{3}(\sin(x))": r"\log^{3}(\sin(x))",
    }),
    "inverse_notation": (L.inverse_notation, {r"\sin^{-1}x": r"\arcsinx", r"\tan^{ -1 }(x)": r"\arctan(x)", r"\cosh ^ -1 (x)": r"\arccosh (x)", r"\cot^(-1)": r"\arccot", r"\sin^{-2}x": r"\sin^{-2}x"}),
    "log_normalize": (L.logarithms, {r"\ln x": r"\log(x)", r"\log2": r"\log(2)", r"\log^2x": r"\log(x)^{2}", r"\ln(x)": r"\log(x)", r"\lnot x": r"\lnot x", r"\log^3 2": r"\log(2)^{3}"}),
    "function_arguments": (L.function_arguments, {r"\sin x": r"\sin(x)", r"\cos 2x": r"\cos(2x)", r"\sinh x": r"\sinh(x)", r"\sin(x)": r"\sin(x)", r"\tan xy": r"\tan xy"}),
    "differentials": (L.differentials, {r"\mathrm{d}x": "dx", r"\text{dx}": "dx", r"f(x)\,dx": "f(x)dx", r"\dx": "dx", r"\textrm{ d } t": "dt"}),
    "sanitize_invisible": (L.sanitized, {"a\u200bb": "ab", "x\u00a0y": "x y", "\ufeffz": "z"}),
    "unwrap_sizes": (column(R.sizes_unwrapped), {r"\left(x\right)": "(x)", r"\left.\frac{1}{x}\right|": r"\frac{1}{x}|", r"\bigl( x \bigr)": "( x )", r"\Big{(}x\Big{)}": "(x)", r"\left\{x\right\}": r"\{x\}", r"\leftarrow": r"\leftarrow"}),
    "strip_colours": (column(R.colours_stripped), {r"\color{red}{x}": "{x}", r"\color{blue} x+1": " x+1", r"\textcolor{red}{y^2}": "y^2", r"\color x": "x", "x": "x"}),
    "unbraced_fractions": (column(R.fractions), {r"\frac12": r"\frac{1}{2}", r"\dfrac{a}{b}": r"\frac{a}{b}", r"\frac\pi2": r"\frac{\pi}{2}", r"\frac{1}x": r"\frac{1}{x}", r"\tfrac 1 2": r"\frac{1}{2}", r"\frac{\frac12}{3}": r"\frac{\frac{1}{2}}{3}", r"\frac{1}": r"\frac{1}"}),
    "unbraced_scripts": (column(R.scripts), {r"x^\frac{1}{2}": r"x^{\frac{1}{2}}", r"x_\alpha": r"x_{\alpha}", r"e^\sqrt{x}": r"e^{\sqrt{x}}", r"2^\sqrt 3": r"2^{\sqrt{3}}", r"x^{\pi}": r"x^{\pi}", "x^2": "x^2"}),
    "over_to_frac": (column(R.over_to_frac), {r"{a \over b}": r"\frac{a}{b}", r"{1+x \over {y}}": r"\frac{1+x}{{y}}", r"x {a} y": r"x {a} y", r"{\overline{x}}": r"{\overline{x}}"}),
    "remaining_artifacts": (column(R.artifacts), {r"\big x": " x", r"\phantom{abc}y": "y", r"\mathrm{d}": "d", r"\text{ erf }(x)": r"\operatorname{erf}(x)", r"a\cdot b": r"a \cdot  b", r"\bigtriangleup": r"\bigtriangleup"}),
    "text_inside": (column(R.text_inside), {r"\text{  for   all }x": r"\text{ for all }x", r"\text {a  b}": r"\text{a b}", r"\textbf{a  b}": r"\textbf{a  b}"}),
    "special_functions": (column(R.special_functions), {r"\sin^2 x + \ln x": r"\sin(x)^{2} + \log(x)", r"\tan^{-1}(x)": r"\arctan(x)", r"\cosh 2x": r"\cosh(2x)"}),
    "clean_side": (column(R.clean_side), {"x + 1 .": "x + 1", r"&= { x } ,": "={x}", " f ( x ) ;": "f(x)", r"a\,": r"a\,", "": ""}),
    "strip_environments": (column(R.stripped), {r"\color{red}\left( \frac12 \right)": r"( \frac{1}{2} )", r"\int\limits^1_0 \ln x \,dx \tag{3}": r"\int_{0}^{1} \log(x) dx"}),
    "main_part": (column(lambda x: R.main_and_condition(x)[0]), {r"x = 1 \text{ for } y > 0": "x = 1", r"f(x) \quad a > 0": "f(x)", "g(x) = x^2 (x > 0)": "g(x) = x^2", "I(a) = a + 1, a > 2": "I(a) = a + 1", "x + 1": "x + 1"}),
    "condition_part": (column(lambda x: R.main_and_condition(x)[1]), {r"x = 1 \text{ for } y > 0": r"\text{ for } y > 0", r"f(x) \quad a > 0": r"\quad a > 0", "g(x) = x^2 (x > 0)": "(x > 0)", "I(a) = a + 1, a > 2": "a > 2", "x + 1": None}),
    "family_classify": (L.family, {"sin(x)": "sin", "asin(x)": "asin,sin", "polylog(2, x)": "log,polylog", "x + 1": "elementary", "x**2/exp(x)": "div,exp,pow", "Abs(cosh(x))": "abs,cosh", "zeta(3)*ln(x)": "log,zeta"}),
}

FLAGS = {
    "predicates_matrix": (L.matrix, {r"\begin{pmatrix} 1 \end{pmatrix}": True, r"\begin{matrix}": True, r"\begin{align}": False}),
    "predicates_implication": (L.implication, {r"a \Rightarrow b": True, r"a \iff b": True, r"a \Leftarrow b": True, "a = b": False}),
    "predicates_piecewise": (L.piecewise, {r"\begin{cases} 1 \\ 2 \end{cases}": True, r"\left\{ a \\ b": True, "x^2": False, r"\begin{array} \text{if } x": True, r"\begin{array}{l} 1 & \text{ only if } x": True, r"\begin{array} x": False}),
    "predicates_multi": (L.multiple_statements, {"x and y": True, r"a \text{or} b": True, "where x = 1": True, "sand": False}),
    "predicates_inequality": (L.inequality, {r"a \le b": True, r"\left( x": False, "a < b": True, "a = b": False, "x ≠ y": True}),
    "integral_prefilter": (L.has_integral, {r"\int x": True, r"\intx": False, r"\int_0^1": True, "int": False}),
    "integral_multiple": (L.multiple_integrals, {r"\int x \int y": True, r"\int x": False}),
    "integral_one_dimensional": (L.one_dimensional, {r"\int x dx": True, r"\iint x dx": False, r"\int x": False, r"\int \int f dx dy": False}),
    "single_letter_ij": (L.single_letter_ij, {"I": True, r"\mathcal{J}_{1}": True, "I(a)": True, "x": False, "J^2": True}),
}


CHAINS = {
    "a = b = c": ("a", "b | c", None), r"I = \int_0^1 f(x) dx = 42": ("I", r"\int_{0}^{1}f(x)dx | 42", None), r"\sin^2(x) + \cos^2(x) = 1 = \sec^2(x) - \tan^2(x)": (r"\sin(x)^{2}+ \cos(x)^{2}", r"1 | \sec(x)^{2}- \tan(x)^{2}", None),
    r"\int_0^1 x^2 dx = \frac{1}{3}": (r"\int_{0}^{1}x^2 dx", r"\frac{1}{3}", None), r"\sin(x) + \cos(x)": (r"\sin(x)+ \cos(x)", "", None), r"A \approx B ≈ C": ("A", "B | C", None),
    r"\int_{0}^{\infty} \frac{1}{(x-\log x)^2}dx≈2.51792": (r"\int_{0}^{\infty}\frac{1}{(x-\log(x))^2}dx", "2.51792", None), r"\begin{align} f(x) &= x^2 \\ &+ 2x + 1 \end{align}": ("f(x)", "x^2 + 2x + 1", None),
    r"f(x) = \begin{cases} 1 \end{cases}": (None, "", "contains_piecewise_function"), "": (None, "", "empty"), "   ": (None, "", "empty_after_parsing"),
}
INTEGRALS = {
    r"\int_0^1 x^2 dx": ("x**2", "x", "0", "1", "definite", None), r"\int \frac{\sin x}{x} dx": ("sin(x)/x", "x", None, None, "indefinite", None), r"\int_{0}^{\infty} e^{-x^2} dx": ("exp(-x**2)", "x", "0", "oo", "definite", None),
    r"\int \sqrt{1-x^2}\, dx": ("sqrt(-x**2 + 1)", "x", None, None, "indefinite", None), "x^2": (None, None, None, None, None, "not_integral_object"), r"\int x^2": (None, None, None, None, None, "no_differential"),
}


def _numbered(spark, d, *cases):
    """(k, input) of each part and each case; in a case, % stands for the number of the part."""
    texts = F.explode(F.array(*map(F.lit, cases))).alias("case")
    numbers = spread(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k")))
    return numbers.select("k", texts).select("k", F.replace("case", F.lit("%"), "k").alias("input"))


NUMBERED_CHAINS = {"a = b = %": ("a", "b | %", None), r"A \approx % ≈ C": ("A", "% | C", None), r"\int_0^1 x^2 dx = \frac{1}{%}": (r"\int_{0}^{1}x^2 dx", r"\frac{1}{%}", None)}
NUMBERED_INTEGRALS = {
    r"\int_0^{%} x^2 dx": ("x**2", "x", "0", "%", "definite", None), r"\int_{%}^{\infty} e^{-x^2} dx": ("exp(-x**2)", "x", "%", "oo", "definite", None),
    "x^2 + %": (None, None, None, None, None, "not_integral_object"),
}


def _normalized(rows):
    return latex_scan.normalized(rows.select(F.col("input").alias("id"), F.col("input").alias("latex"))).select(F.col("id").alias("input"), F.col("leading").alias("first_form"), F.array_join("equivalents", " | ").alias("equivalents"), "reason")


def _integrals(rows):
    found = latex_scan.integrals(rows.select(F.col("input").alias("id"), F.col("input").alias("latex"))).withColumn("canonical", E.describe("integrand")["canonical"])
    return found.select(F.col("id").alias("input"), F.col("canonical").alias("integrand"), "variable", "lower", "upper", "kind", "error")


def normalize_latex(spark, d):
    return _normalized(_numbered(spark, d, *NUMBERED_CHAINS))


def parse_integrals(spark, d):
    """Integrals read and brought into canonical form."""
    return _integrals(_numbered(spark, d, *NUMBERED_INTEGRALS))


def single_letter_ij(spark, d):
    return _numbered(spark, d, "I(%)", "x + %").select("input", L.single_letter_ij(F.col("input")).alias("output"))


#: What does not depend on the number before an expression.
_APART = {"family_classify", "condition_part", *FLAGS}


def _golden(function, cases):
    def query(spark, d):
        return _numbered(spark, d, *(f"% + {c}" for c in cases if c)).select("input", function(F.col("input")).alias("output"))

    return query


def _check(function, cases):
    def query(spark, d):
        return spark.createDataFrame([(k,) for k in cases], "input string").select("input", function(F.col("input")).alias("output"))

    return query


def _expected(cases) -> str:
    rows = ", ".join(f"({sql_text(k)}, {v if isinstance(v, bool) else sql_text(v)})" for k, v in cases.items())
    return f"SELECT * FROM (VALUES {rows}) t(input, output)"


def _expected_numbered(name: str, cases) -> str:
    output = "output" if name in _APART else "p_partkey || ' + ' || output"
    return f"SELECT p_partkey || ' + ' || input AS input, {output} AS output FROM part, ({_expected({k: v for k, v in cases.items() if k})})"


def extract_display_math(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(L.display_math(F.col("text")))).alias("m"))
    return found.groupBy("doc_id", F.col("m.latex").alias("latex")).agg(F.min("m.pattern_index").alias("pattern_index"))


def latex_reject_cascade(spark, d):
    return table(spark, d, "documents").select("doc_id", L.reject_reason(F.col("text")).alias("reason"))


def differential_scan(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all(t, F.lit(r"\$\$"), F.lit(0))).alias("dollars"), L.inequality(t).alias("inequality"))


_TABLES = {name: x for name, x in (GOLDEN | FLAGS).items() if name != "single_letter_ij"}
QUERIES = {f.__name__: f for f in (extract_display_math, latex_reject_cascade, differential_scan, normalize_latex, parse_integrals, single_letter_ij)}
QUERIES |= {name: _golden(*x) for name, x in _TABLES.items()}
CHECKS = {f"golden_{name}": _check(*x) for name, x in (GOLDEN | FLAGS).items()}
CHECKS |= {"golden_normalize_latex": lambda spark, d: _normalized(spark.createDataFrame([(k,) for k in CHAINS], "input string")), "golden_parse_integrals": lambda spark, d: _integrals(spark.createDataFrame([(k,) for k in INTEGRALS], "input string"))}

_W = r"[^\p{L}\p{N}_]"
_SQL_RULES = [(p.replace("(?U)", ""), r) for p, r in L.REJECTIONS]


def _sql_rule(p: str) -> str:
    p = rf"(^|{_W})" + p[2:] if p.startswith(r"\b") else p
    p = p[:-2] + rf"($|{_W})" if p.endswith(r"\b") else p
    hit = f"regexp_matches(text, {sql_text(p)})"
    if p == "[A-Z][a-z]":
        hit += f" AND NOT (regexp_extract(text, '[A-Z][a-z]') = 'Li' OR regexp_matches(text, {sql_text(L.POLYLOG)}))"
    return hit


def _rows(cases, names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(sql_text(x) for x in (k, *v)) + ")" for k, v in cases.items()) + f") t({names})"


def _rows_numbered(cases, names: str) -> str:
    columns = ", ".join(f"replace({n}, '%', p_partkey::VARCHAR) AS {n}" for n in names.split(", "))
    return f"SELECT {columns} FROM part, ({_rows(cases, names)})"


_CHAIN, _INTEGRAL = "input, first_form, equivalents, reason", "input, integrand, variable, lower, upper, kind, error"
ORACLE_SQL = {name: _expected_numbered(name, cases) for name, (_, cases) in _TABLES.items()}
ORACLE_SQL |= {f"golden_{name}": _expected(cases) for name, (_, cases) in (GOLDEN | FLAGS).items()}
ORACLE_SQL |= {"golden_normalize_latex": _rows(CHAINS, _CHAIN), "golden_parse_integrals": _rows(INTEGRALS, _INTEGRAL), "normalize_latex": _rows_numbered(NUMBERED_CHAINS, _CHAIN), "parse_integrals": _rows_numbered(NUMBERED_INTEGRALS, _INTEGRAL)}
ORACLE_SQL["single_letter_ij"] = "SELECT unnest(['I(' || p_partkey || ')', 'x + ' || p_partkey]) AS input, unnest([true, false]) AS output FROM part"
ORACLE_SQL |= {
    "extract_display_math": r"""WITH m AS (
  SELECT doc_id, 0 AS k, unnest(regexp_extract_all(text, '(?s)\$\$(.+?)\$\$', 1)) AS l FROM documents UNION ALL
  SELECT doc_id, 1, unnest(regexp_extract_all(text, '(?s)\\\[(.+?)\\\]', 1)) FROM documents UNION ALL
  SELECT doc_id, 2, unnest(regexp_extract_all(text, '(?s)\\begin\{align\*?\}(.+?)\\end\{align\*?\}', 1)) FROM documents UNION ALL
  SELECT doc_id, 3, unnest(regexp_extract_all(text, '(?s)\\begin\{equation\*?\}(.+?)\\end\{equation\*?\}', 1)) FROM documents
) SELECT doc_id, trim(l) AS latex, min(k) AS pattern_index FROM m GROUP BY ALL""",
    "latex_reject_cascade": "SELECT doc_id, CASE " + " ".join(f"WHEN {_sql_rule(p)} THEN {sql_text('latex_rejected: ' + r)}" for p, r in _SQL_RULES) + " END AS reason FROM documents",
    "differential_scan": r"SELECT doc_id, len(regexp_extract_all(text, '\$\$')) AS dollars, regexp_matches(text, '\\(" + L.INEQUALITIES + ")([^a-zA-Z]|$)|[" + L.INEQUALITY_SIGNS + "]') AS inequality FROM documents",
}
