"""Deep nesting and unclosed braces take time in proportion to the text, and no recursion."""

import time

import pytest

from sumforge.functions import latex_reader as R
from sumforge.functions import latex_scan as L

DEPTH = 3000


def test_nested_fractions_are_all_rewritten():
    s = r"\dfrac{" * DEPTH + "x" + "}2" * DEPTH
    assert R.fractions(s) == r"\frac{" * DEPTH + "x" + "}{2}" * DEPTH


def test_nested_over_is_all_rewritten():
    s = r"{a \over " * DEPTH + "b" + "}" * DEPTH
    assert R.over_to_frac(s) == r"\frac{a}{" * DEPTH + "b" + "}" * DEPTH


@pytest.mark.parametrize(("given", "wanted"), [
    (r"\frac12", r"\frac{1}{2}"), (r"\frac\alpha{\tfrac ab}", r"\frac{\alpha}{\frac{a}{b}}"), (r"\dfrac", r"\frac"), (r"\frac{1}", r"\frac{1}"), (r"{\frac12", r"{\frac{1}{2}"), (r"\frac{\frac}{2}", r"\frac{\frac}{2}"),
])
def test_fractions(given, wanted):
    assert R.fractions(given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [
    (r"{1 \over {2 \over 3}}", r"\frac{1}{\frac{2}{3}}"), (r"{{1 \over 2}}", r"{\frac{1}{2}}"), (r"{1 \over 2", r"{1 \over 2"), (r"\over", r"\over"), (r"{a\over\ }", r"\frac{a}{\ }"), (r"{a} \over {b}", r"{a} \over {b}"),
])
def test_over(given, wanted):
    assert R.over_to_frac(given) == wanted


@pytest.mark.parametrize("text", ["{" * 20_000, "}" * 20_000, r"\frac{" * 20_000, r"{a \over " * 5_000 + "}" * 5_000, r"\int " + "(" * DEPTH + "x" + ")" * DEPTH + " dx", r"\int " + r"\frac{" * DEPTH + "x" + "}{2}" * DEPTH + " dx"])
def test_no_text_fails_or_takes_long(text):
    start = time.process_time()
    R.stripped(text)
    L.normalize(text)
    L.integral(text)
    assert time.process_time() - start < 20


def test_a_text_without_what_a_pass_looks_for_is_not_walked(monkeypatch):
    walked = []
    monkeypatch.setattr(R, "tokens", lambda s: walked.append(s) or [])
    s = "1 + x"
    for one in (R.function_powers, R.inverse_notation, R.logarithms, R.function_arguments, R.differentials, R.integral_bounds, R.sizes_unwrapped, R.colours_stripped, R.scripts, R.artifacts, R.text_inside, R.tags, R.fractions, R.over_to_frac, R.limits_removed, R.alignment_removed):
        assert one(s) == s
    assert not walked
