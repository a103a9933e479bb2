"""Two-sample KS p-value as a JVM-side Spark expression.

The two-sided p-value of statistic ``d`` at effective sample size
``n = round_half_even(n1 * n2 / (n1 + n2))`` is 1 minus the Kolmogorov
distribution, expanded in powers of n^(-1/2) to the third order (Pelz and Good,
1976), at ``z = d sqrt(n)``: one formula at all sizes. Its theta series are
summed in the form that converges fast for small z, exp(-(2k-1)^2 pi^2 / 8 z^2);
with ``TERMS`` terms what is left out is below 1e-17 up to ``Z_MAX``, and beyond
it p is below 1e-80. The oracle sums the dual form, exp(-2 k^2 z^2).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = 32
Z_MAX = 10.0
Z_MIN = 0.05  # below it p is 1 to the last bit of a double


def _cdf(z: Column, n: Column) -> Column:
    pi2 = math.pi ** 2
    z2 = z * z

    def step(acc: Column, k: Column) -> Column:
        m2 = (2.0 * k - 1.0) * (2.0 * k - 1.0) / 4.0
        q = F.exp(-m2 * pi2 / (2.0 * z2))
        k2 = (k * k).cast("double")
        r = F.exp(-k2 * pi2 / (2.0 * z2))
        t1 = pi2 * m2 - z2
        t2 = (6.0 * z2 * z2 * z2 + 2.0 * z2 * z2 + pi2 * (2.0 * z2 * z2 - 5.0 * z2) * m2
              + pi2 ** 2 * (1.0 - 2.0 * z2) * m2 * m2)
        t3 = (-30.0 * z2 * z2 * z2 - 90.0 * z2 * z2 * z2 * z2 + pi2 * (135.0 * z2 * z2 - 96.0 * z2 * z2 * z2) * m2
              + pi2 ** 2 * (212.0 * z2 * z2 - 60.0 * z2) * m2 * m2 + pi2 ** 3 * (5.0 - 30.0 * z2) * m2 * m2 * m2)
        return F.struct((acc["k0"] + q).alias("k0"), (acc["k1"] + q * t1).alias("k1"),
                        (acc["k2"] + q * t2).alias("k2"), (acc["k3"] + q * t3).alias("k3"),
                        (acc["e2"] + r * k2).alias("e2"),
                        (acc["e3"] + r * (3.0 * pi2 * k2 * z2 - pi2 ** 2 * k2 * k2)).alias("e3"))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("k0", "k1", "k2", "k3", "e2", "e3")])

    def finish(s: Column) -> Column:
        half = math.sqrt(math.pi / 2)
        k0 = s["k0"] * math.sqrt(2 * math.pi) / z
        k1 = s["k1"] * half / (3.0 * F.pow(z, F.lit(4.0)))
        k2 = s["k2"] * half / (36.0 * F.pow(z, F.lit(7.0))) - s["e2"] * pi2 * half / (18.0 * F.pow(z, F.lit(3.0)))
        k3 = s["k3"] * half / (3240.0 * F.pow(z, F.lit(10.0))) + s["e3"] * half / (108.0 * F.pow(z, F.lit(6.0)))
        root = F.sqrt(n)
        return k0 + k1 / root + k2 / n + k3 / (n * root)
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), zero, step, finish)


def ks_pvalue(d: Column, n1: Column, n2: Column) -> Column:
    """p-value; null where a sample is empty."""
    total = (n1 + n2).cast("double")
    n = F.bround(F.try_divide(n1.cast("double") * n2.cast("double"), total), 0)
    z = d * F.sqrt(n)
    p = F.lit(1.0) - _cdf(F.when((z >= Z_MIN) & (z <= Z_MAX), z), n)
    return (F.when(n.isNull() | (n1 == 0) | (n2 == 0), F.lit(None).cast("double"))
             .when(d >= 1, F.lit(0.0)).when(z < Z_MIN, F.lit(1.0)).when(z > Z_MAX, F.lit(0.0))
             .otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))))


def sql_ks_pvalue(d: str, n1: str, n2: str) -> str:
    """DuckDB twin (oracle): the alternating dual series, as many terms as its
    slow convergence at small z needs."""
    n = f"round_even(({n1})::DOUBLE * ({n2}) / (({n1}) + ({n2})), 0)"
    z = f"(({d}) * sqrt({n}))"
    odd = "(CASE WHEN k % 2 = 1 THEN 1.0 ELSE 0.0 END)"
    f1, f2 = f"(k * k - {odd})", f"(5 * k * k + 22 - 15 * {odd})"
    kz = f"(k * k * {z} * {z})"
    term = (f"1 - 2 * k * k * {z} / (3 * sqrt({n})) - ({f1} - 4 * ({f1} + 3) * {kz} + 8 * {kz} * {kz}) / (18 * {n})"
            f" + k * k * {z} / (27 * {n} * sqrt({n})) * ({f2} / 5 - 4 * ({f2} + 45) * {kz} / 15 "
              f"+ 8 * {kz} * {kz})")
    series = (f"(SELECT sum((CASE WHEN k % 2 = 1 THEN -1.0 ELSE 1.0 END) * exp(-2 * {kz}) * ({term})) "
              f"FROM (SELECT t::DOUBLE AS k FROM range(1, CAST(ceil(8 / {z}) AS BIGINT) + 3) r(t)))")
    p = (f"CASE WHEN ({n1}) = 0 OR ({n2}) = 0 THEN NULL WHEN ({d}) >= 1 THEN 0.0 "
         f"WHEN {z} < {Z_MIN} THEN 1.0 WHEN {z} > {Z_MAX} THEN 0.0 ELSE least(greatest(-2 * {series}, 0.0), 1.0) END")
    return f"({p})"
