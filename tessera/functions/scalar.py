"""Element-wise functions: (columns, scalars) -> column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .guards import INF, day, div, fin, flag, power, real

ANY = -1


def _fold(step):
    return lambda c, s: reduce(step, c)


def _log(c, s):
    x = fin(c[0])
    return F.when(x == -1, -INF).when(x > -1, F.log1p(F.when(x > -1, x)))


def _signed(c, e):
    x = fin(c[0])
    return F.signum(x) * power(F.abs(x), e)


def _valid(one):
    return lambda c, s: real(one(fin(c[0])))


def _extreme(pick):
    return lambda c, s: c[0] if len(c) == 1 else pick(*c)


def _bound(c, s):
    x, y = fin(c[0]), fin(c[1])
    return flag(F.abs(x - y) <= s[0])


#: name -> (inputs or ANY, scalars, builder)
SCALAR = {
    "abs": (1, 0, _valid(F.abs)),
    "flip": (1, 0, _valid(lambda x: -x)),
    "neg": (1, 0, _valid(lambda x: -x)),
    "inverse": (1, 0, _valid(lambda x: F.when(x == 0, INF).otherwise(1 / F.when(x != 0, x)))),
    "log": (1, 0, _log),
    "sigmoid": (1, 0, _valid(lambda x: 1 / (1 + F.exp(-x)))),
    "sign": (1, 0, _valid(F.signum)),
    "sinh": (1, 0, _valid(F.sinh)),
    "tanh": (1, 0, _valid(F.tanh)),
    "sin": (1, 0, lambda c, s: real(F.sin(c[0]))),
    "cos": (1, 0, lambda c, s: real(F.cos(c[0]))),
    "tan": (1, 0, lambda c, s: real(F.tan(c[0]))),
    "cot": (1, 0, lambda c, s: F.when(c[0] == 0, INF).otherwise(real(F.cot(F.when(c[0] != 0, c[0]))))),
    "fill_na": (1, 0, lambda c, s: F.coalesce(fin(c[0]), F.lit(0.0))),
    "is_valid": (1, 0, lambda c, s: fin(c[0]).isNotNull().cast("double")),
    "const": (0, 1, lambda c, s: F.lit(float(s[0]))),
    "bound": (2, 1, _bound),
    "pow": (1, 1, lambda c, s: power(fin(c[0]), s[0])),
    "spow": (1, 1, lambda c, s: _signed(c, s[0])),
    "pow_int": (1, 1, lambda c, s: power(fin(c[0]), int(s[0]))),
    "spow_int": (1, 1, lambda c, s: _signed(c, int(s[0]))),
    "add": (ANY, 0, _fold(lambda a, b: real(a + b))),
    "sub": (ANY, 0, _fold(lambda a, b: real(a - b))),
    "mul": (ANY, 0, _fold(lambda a, b: real(a * b))),
    "div": (ANY, 0, _fold(div)),
    ">": (2, 0, lambda c, s: flag(c[0] > c[1])),
    ">=": (2, 0, lambda c, s: flag(c[0] >= c[1])),
    "<": (2, 0, lambda c, s: flag(c[0] < c[1])),
    "<=": (2, 0, lambda c, s: flag(c[0] <= c[1])),
    "==": (2, 0, lambda c, s: flag(c[0] == c[1])),
    "!=": (2, 0, lambda c, s: flag(c[0] != c[1], True)),
    "&": (ANY, 0, lambda c, s: reduce(lambda a, b: a & b, [F.coalesce(x != 0, F.lit(True)) for x in c]).cast("double")),
    "|": (ANY, 0, lambda c, s: reduce(lambda a, b: a | b, [F.coalesce(x != 0, F.lit(True)) for x in c]).cast("double")),
    "filter_v": (2, 0, lambda c, s: F.when(fin(c[1]).isNotNull(), c[0])),
    "filter": (2, 0, lambda c, s: F.when(F.coalesce(c[1] != 0, F.lit(True)), c[0])),
    "max": (ANY, 0, _extreme(F.greatest)),
    "min": (ANY, 0, _extreme(F.least)),
    "diff_date": (2, 0, lambda c, s: F.datediff(day(fin(c[0])), day(fin(c[1]))).cast("double")),
    "if": (3, 0, lambda c, s: F.when(F.coalesce(c[0] != 0, F.lit(True)), c[1]).otherwise(c[2])),
}
SCALAR |= {"+": SCALAR["add"], "-": SCALAR["sub"], "*": SCALAR["mul"], "/": SCALAR["div"]}
