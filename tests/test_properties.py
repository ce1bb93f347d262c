"""Property tests: the Spark rules equal a plain-Python statement of the same rule."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from tuneshelf.functions import rules as R

FLOATS = st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False)


def py_round_half_up(x: float, d: int) -> float:
    m = float(10 ** d)
    return math.floor(x * m + 0.5) / m + 0.0


@settings(max_examples=25, deadline=None)
@given(st.lists(FLOATS, min_size=1, max_size=50), st.integers(min_value=0, max_value=4))
def test_round_half_up_matches_rule(spark, xs, d):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(R.round_half_up("x", d)).collect()]
    assert got == [py_round_half_up(x, d) for x in xs]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(FLOATS.map(repr), st.sampled_from(["", "abc", "NaN", " 2.5 ", None])),
                min_size=1, max_size=50))
def test_safe_matches_rule(spark, texts):
    def py_safe(t):
        if t is None:
            return None
        try:
            f = float(t)
        except ValueError:
            return None
        return None if math.isnan(f) else py_round_half_up(f, 2)

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(R.safe("t")).collect()]
    assert got == [py_safe(t) for t in texts]
