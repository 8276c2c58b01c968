"""Distribution functions as column expressions: no Python runs for them, and a row takes only as many steps as its values need.

Fractions, inverses and tail sums are `aggregate` over a sequence whose length is bounded by the row's own values; once a state has converged the
steps that are left pass it on unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of Stirling's series: B(2k) / (2k (2k - 1)) over x ** (2k - 1). Fixed values.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
SHIFT = 8
#: Steps of an inverse at most, and of a fraction: a start and a multiple of the square root of its larger parameter.
INVERSE_STEPS = 200
FRACTION_STEPS, FRACTION_GROWTH = 60, 12
TINY = 1e-300


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def state(**fields: Column) -> Column:
    return F.struct(*(c.alias(k) for k, c in fields.items()))


def log_gamma(x: Column) -> Column:
    """Of x > 0, by Stirling's series at x + 8."""

    def series(y: Column) -> Column:
        tail = sum((t / F.pow(y, F.lit(2.0 * k + 1)) for k, t in enumerate(STIRLING)), F.lit(0.0))
        return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + tail

    product = x
    for k in range(1, SHIFT):
        product = product * (x + k)
    return let(x + SHIFT, series) - F.log(product)


def log_beta(a: Column, b: Column) -> Column:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function by Lentz's method, half a step at a time."""
    fine = lambda v: F.when(F.abs(v) < TINY, TINY).otherwise(v)

    def step(s: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = k % 2 == 0
        top = F.when(even, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))).otherwise(-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        both = let(top, lambda t: state(c=fine(1 + t / s["c"]), d=1 / fine(1 + t * s["d"])))
        after = let(both, lambda n: state(c=n["c"], d=n["d"], out=s["out"] * n["c"] * n["d"], done=~even & (F.abs(n["c"] * n["d"] - 1) < 1e-15)))
        return F.when(s["done"], s).otherwise(after)

    first = let(1 / fine(1 - (a + b) * x / (a + 1)), lambda d: state(c=F.lit(1.0), d=d, out=d, done=F.lit(False)))
    steps = F.ceil(FRACTION_STEPS + FRACTION_GROWTH * F.sqrt(F.greatest(a, b))).cast("int")
    return F.aggregate(F.sequence(F.lit(2), steps), first, step, lambda s: s["out"])


def _beta_cdf(a: Column, b: Column, x: Column, log_whole: Column) -> Column:
    """beta_cdf() inside (0, 1), given log_beta(a, b)."""

    def side(p: Column) -> Column:
        front = F.exp(p["a"] * F.log(p["x"]) + p["b"] * F.log1p(-p["x"]) - log_whole)
        value = front * _beta_fraction(p["a"], p["b"], p["x"]) / p["a"]
        return F.when(p["swap"], 1 - value).otherwise(value)

    swap = x > (a + 1) / (a + b + 2)
    return let(state(swap=swap, a=F.when(swap, b).otherwise(a), b=F.when(swap, a).otherwise(b), x=F.when(swap, 1 - x).otherwise(x)), side)


def _doubles(*values: Column | float) -> list[Column]:
    return [(v if isinstance(v, Column) else F.lit(v)).cast("double") for v in values]


def beta_cdf(a: Column | float, b: Column | float, x: Column) -> Column:
    """Regularised incomplete beta function of a, b > 0; null where one of the three is."""
    a, b, x = _doubles(a, b, x)
    inside = let(state(a=a, b=b, x=x), lambda p: _beta_cdf(p["a"], p["b"], p["x"], log_beta(p["a"], p["b"])))
    return F.when((x <= 0) & a.isNotNull() & b.isNotNull(), 0.0).when((x >= 1) & a.isNotNull() & b.isNotNull(), 1.0).when(x.isNotNull() & a.isNotNull() & b.isNotNull(), inside)


def beta_quantile(q: Column | float, a: Column | float, b: Column | float) -> Column:
    """x with beta_cdf(a, b, x) = q, by Newton's steps where they stay between the bounds known so far, else by halving."""
    q, a, b = _doubles(q, a, b)

    def solved(p: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            def moved(gap: Column) -> Column:
                bounds = state(low=F.when(gap < 0, s["x"]).otherwise(s["low"]), high=F.when(gap < 0, s["high"]).otherwise(s["x"]))
                slope = F.exp((p["a"] - 1) * F.log(s["x"]) + (p["b"] - 1) * F.log1p(-s["x"]) - p["whole"])
                newton = F.when(slope > 0, s["x"] - gap / slope)

                def placed(n: Column) -> Column:
                    inside = F.coalesce((n["newton"] >= n["low"]) & (n["newton"] <= n["high"]), F.lit(False))
                    x = F.when(gap == 0, s["x"]).when(inside, n["newton"]).otherwise((n["low"] + n["high"]) / 2)
                    return let(x, lambda x: state(low=n["low"], high=n["high"], x=x, done=F.abs(x - s["x"]) <= 1e-15 * s["x"]))

                return let(bounds, lambda w: let(state(low=w["low"], high=w["high"], newton=newton), placed))

            return F.when(s["done"], s).otherwise(let(_beta_cdf(p["a"], p["b"], s["x"], p["whole"]) - p["q"], moved))

        first = state(low=F.lit(0.0), high=F.lit(1.0), x=p["a"] / (p["a"] + p["b"]), done=F.lit(False))
        return F.aggregate(F.sequence(F.lit(1), F.lit(INVERSE_STEPS)), first, step, lambda s: s["x"])

    known = q.isNotNull() & a.isNotNull() & b.isNotNull()
    return F.when(known & (q <= 0), 0.0).when(known & (q >= 1), 1.0).when(known, let(state(q=q, a=a, b=b, whole=log_beta(a, b)), solved))


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) of Student's distribution; null where df isn't above 0 or either isn't known."""
    t, df = _doubles(t, df)
    return F.when((df > 0) & ~F.isnan(df) & (df < float("inf")) & ~F.isnan(t), beta_cdf(df / 2, 0.5, df / (df + t * t)))


def t_quantile(p: float, df: Column) -> Column:
    """The upper quantile, P(T <= t) = p for p of at least a half."""
    (df,) = _doubles(df)
    return F.when(df > 0, let(beta_quantile(2 * p - 1, 0.5, df / 2), lambda z: F.sqrt(df * z / (1 - z))))


def hypergeometric_two_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of a 2 x 2 table of counts: of all tables with its margins, those no likelier than it.

    Each tail begins where a search by halves finds the first such table, and is summed outward until its terms no longer count.
    """
    a, b, c, d = _doubles(a, b, c, d)

    def summed(m: Column) -> Column:
        log_p = lambda x: m["top"] - log_gamma(x + 1) - log_gamma(m["r"] - x + 1) - log_gamma(m["k"] - x + 1) - log_gamma(m["s"] - m["k"] + x + 1)

        def first_rare(inner: Column, outer: Column) -> Column:
            """The table nearest the mode, from inner to outer, that is no likelier than the one seen; one beyond outer if none is."""
            away = F.signum(outer - inner)

            def halve(s: Column, _: Column) -> Column:
                def split(middle: Column) -> Column:
                    rare = log_p(inner + away * middle) <= m["seen"] + 1e-7
                    return let(rare, lambda y: state(low=F.when(y, s["low"]).otherwise(middle + 1), high=F.when(y, middle).otherwise(s["high"])))

                return F.when(s["low"] >= s["high"], s).otherwise(let(F.floor((s["low"] + s["high"]) / 2).cast("double"), split))

            return F.aggregate(F.sequence(F.lit(1), F.lit(64)), state(low=F.lit(0.0), high=F.abs(outer - inner) + 1), halve, lambda s: s["low"])

        def tail(inner: Column, outer: Column, away: int) -> Column:
            def outward(skipped: Column) -> Column:
                start = inner + away * skipped
                left, right = (lambda x: x * (m["s"] - m["k"] + x)), (lambda x: (m["r"] - x) * (m["k"] - x))

                def step(s: Column, _: Column) -> Column:
                    x = s["x"]
                    ratio = right(x) / ((x + 1) * (m["s"] - m["k"] + x + 1)) if away > 0 else left(x) / ((m["r"] - x + 1) * (m["k"] - x + 1))
                    more = let(s["term"] * ratio, lambda t: state(x=x + away, term=t, sum=s["sum"] + t))
                    return F.when((s["term"] <= 1e-18 * s["sum"]) | (x == outer), s).otherwise(more)

                # a term falls at least as fast as one a standard deviation further in does, so this many reach the end of what counts
                steps = F.ceil(F.least(F.abs(outer - start), 100 + 50 * m["sd"])).cast("int")
                return F.when(
                    skipped <= F.abs(outer - inner),
                    let(F.exp(log_p(start)), lambda t: F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), state(x=start, term=t, sum=t), step, lambda s: s["sum"])),
                ).otherwise(0.0)

            return F.when((outer - inner) * away >= 0, let(first_rare(inner, outer), outward)).otherwise(0.0)

        return F.least(F.lit(1.0), tail(m["mode"], m["low"], -1) + tail(m["mode"] + 1, m["high"], 1))

    def with_log(m: Column) -> Column:
        top = log_gamma(m["r"] + 1) + log_gamma(m["s"] + 1) + log_gamma(m["k"] + 1) + log_gamma(m["n"] - m["k"] + 1) - log_gamma(m["n"] + 1)
        seen = top - log_gamma(a + 1) - log_gamma(b + 1) - log_gamma(c + 1) - log_gamma(d + 1)
        spread = F.sqrt(m["r"] * m["s"] * m["k"] * (m["n"] - m["k"]) / F.greatest(m["n"] * m["n"] * (m["n"] - 1), F.lit(1.0)))
        low, high = F.greatest(F.lit(0.0), m["k"] - m["s"]), F.least(m["r"], m["k"])
        mode = F.floor((m["r"] + 1) * (m["k"] + 1) / (m["n"] + 2)).cast("double")
        return let(state(r=m["r"], s=m["s"], k=m["k"], top=top, seen=seen, sd=spread, low=low, high=high, mode=F.greatest(low, F.least(high, mode))), summed)

    known = a.isNotNull() & b.isNotNull() & c.isNotNull() & d.isNotNull()
    return F.when(known, let(state(r=a + b, s=c + d, k=a + c, n=a + b + c + d), with_log))
