"""The inverse normal distribution function as a column expression (no UDF)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: Wichura's AS 241 (PPND16) coefficients, lowest power first ----------------------------
_CENTRE_NUM = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
               4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
_CENTRE_DEN = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
               2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
_NEAR_NUM = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
             1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
_NEAR_DEN = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
             1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
_FAR_NUM = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
            2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
_FAR_DEN = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
            7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def probit(p: Column) -> Column:
    """Standard normal quantile of p in (0, 1), to double precision; null outside."""
    q = p - F.lit(0.5)
    centre = F.lit(0.180625) - q * q
    tail = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    near, far = tail - F.lit(1.6), tail - F.lit(5.0)
    out = F.when(tail <= 5.0, _poly(near, _NEAR_NUM) / _poly(near, _NEAR_DEN)).otherwise(_poly(far, _FAR_NUM) / _poly(far, _FAR_DEN))
    value = F.when(F.abs(q) <= 0.425, q * _poly(centre, _CENTRE_NUM) / _poly(centre, _CENTRE_DEN)).otherwise(F.signum(q) * out)
    return F.when((p > 0) & (p < 1), value)
