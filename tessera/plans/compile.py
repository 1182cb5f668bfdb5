"""From a parsed expression to DataFrame columns.

Equal parts of an expression, by their normal text, are computed once.  Parts
with windows become columns of their own, so that functions over the same
partitioning follow each other without another shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cross import CROSS, GROUP
from ..functions.guards import fin, real
from ..functions.scalar import ANY, SCALAR
from ..functions.series import RAW_ONLY, SERIES, Frame
from .parse import Node, parse

#: Longest gap, in rows, that plain trailing functions fill.
FILL = 60


def number(node: Node) -> float:
    if node.children:
        raise ValueError(f"a number is wanted, not {node}")
    return float(node.value)


class Plan:
    """Adds the columns of one expression to a dense panel (dti, ii, fields, and a Boolean universe mask)."""

    def __init__(self, panel: DataFrame, mask: str | None = "univ", date: str = "dti", key: str = "ii"):
        self.df, self.mask, self.date, self.key = panel, mask, date, key
        self.done: dict[str, Column] = {}
        self.fields = set(panel.columns)

    def name(self) -> str:
        return f"_x{len(self.done)}_{len(self.df.columns)}"

    def keep(self, c: Column) -> Column:
        name = self.name()
        self.df = self.df.withColumn(name, c)
        return F.col(name)

    def masked(self, c: Column) -> Column:
        return F.when(F.col(self.mask), c) if self.mask else c

    def build(self, node: Node) -> Column:
        text = str(node)
        if text not in self.done:
            self.done[text] = self.make(node)
        return self.done[text]

    def make(self, node: Node) -> Column:
        name, parts = node.value, node.children
        if not parts:
            if name in self.fields:
                return real(F.col(name))
            return F.lit(number(node))
        if name in SCALAR:
            inputs, scalars, build = SCALAR[name]
            n = len(parts) - scalars
            if n < 1 and inputs == ANY or inputs != ANY and n != inputs:
                raise ValueError(f"{name} takes another number of arguments: {node}")
            return build([self.build(p) for p in parts[:n]], [number(p) for p in parts[n:]])
        if name in ("c_reg", "ts_reg"):
            return self.regression(name, node)
        if name in CROSS:
            scalars, build = CROSS[name]
            self.arity(node, 1 + scalars)
            x = self.keep(fin(self.masked(self.build(parts[0]))))
            return self.keep(build(x, [number(p) for p in parts[1:]], [self.date], self.keep))
        if name in GROUP:
            scalars, build = GROUP[name]
            self.arity(node, 2 + scalars)
            group = F.col(parts[-1].value)
            x = self.keep(fin(self.masked(self.build(parts[0]))))
            own = F.when(group >= 0, x)
            inside = build(self.keep(own), [number(p) for p in parts[1:-1]], [self.date, group], self.keep)
            some = F.max(group).over(Window.partitionBy(self.date)) >= 0  # a date without groups stays as it is
            return self.keep(F.when(F.coalesce(some, F.lit(False)), F.when(group >= 0, inside)).otherwise(x))
        raw = name.endswith("_raw")
        spec = SERIES.get(name.removesuffix("_raw")) or (None if raw else RAW_ONLY.get(name))
        if not spec:
            raise ValueError(f"unknown function {name}")
        inputs, scalars, more, build = spec
        self.arity(node, inputs + scalars)
        s = [number(p) for p in parts[inputs:]]
        rows = int(s[0] + (s[1] if more == math.inf else more))
        return self.series([self.build(p) for p in parts[:inputs]], s, rows, raw or name in RAW_ONLY, build, name == "ts_count")

    def arity(self, node: Node, n: int) -> None:
        if len(node.children) != n:
            raise ValueError(f"{node.value} takes {n} arguments: {node}")

    def series(self, inputs: list[Column], s: list[float], rows: int, raw: bool, build, any_value: bool = False) -> Column:
        now = [self.keep(fin(c)) for c in inputs]
        own = Window.partitionBy(self.key).orderBy(self.date)
        t = self.keep(F.row_number().over(own))
        if raw:
            frame = Frame(now[0], now[1] if len(now) > 1 else None, t, own.rowsBetween(1 - rows, 0), True, None, own, self.keep)
            return self.keep(real(build(frame, s)) if any_value else F.when(now[0].isNotNull(), real(build(frame, s))))
        filled = [self.keep(self.filled(x, t, own)) for x in now]
        gap = filled[0].isNull() if len(filled) == 1 else filled[0].isNull() | filled[1].isNull()
        seg = self.keep(F.sum(gap.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
        broken = self.keep(gap)
        line = Window.partitionBy(self.key, seg, broken).orderBy(self.date)
        frame = Frame(filled[0], filled[1] if len(filled) > 1 else None, t, line.rowsBetween(1 - rows, 0), False, None, line, self.keep)
        valid = now[0].isNotNull() if len(now) == 1 else now[0].isNotNull() & now[1].isNotNull()
        return self.keep(F.when(valid, real(build(frame, s))))

    def filled(self, x: Column, t: Column, own, most: float = FILL) -> Column:
        """Gaps of up to ``most`` rows between two valid cells, filled along a line."""
        back, ahead = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
        at = F.when(x.isNotNull(), t)
        x0, t0, x1, t1 = F.last(x, True).over(back), F.last(at, True).over(back), F.first(x, True).over(ahead), F.first(at, True).over(ahead)
        return F.coalesce(x, F.when(t1 - t0 - 1 <= most, x0 + (x1 - x0) * (t - t0) / F.when(t1 > t0, t1 - t0)))

    def regression(self, name: str, node: Node) -> Column:
        """Least squares without intercept on any number of regressors, from sums over the frame: coefficient k, or for 0 the residual."""
        *inputs, n, k = node.children
        if len(inputs) < 2:
            raise ValueError(f"{name} takes a target and regressors")
        y, *xs = [self.keep(fin(self.masked(self.build(p)) if name == "c_reg" else self.build(p))) for p in inputs]
        full = y.isNotNull()
        for x in xs:
            full = full & x.isNotNull()
        pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:]] + [(x, y) for x in xs]
        rows = int(number(n))
        frame = Window.partitionBy(self.key).orderBy(self.date).rowsBetween(1 - rows, 0)
        parts = [F.sum(F.when(full, a * b)) for a, b in pairs] + [F.count(F.when(full, 1))]
        if name == "c_reg":
            # a date's sums stand in each of its rows, so an instrument's last rows have those of the last dates
            of_date = Window.partitionBy(self.date)
            parts = [F.sum(d) for d in [self.keep(F.coalesce(p.over(of_date), F.lit(0))) for p in parts]]
        *s, count = [self.keep(p.over(frame)) for p in parts]
        b = [self.keep(F.when(count >= len(xs), c)) for c in self.solved(s, len(xs))]
        k = int(number(k))
        out = self.keep(b[k - 1] if k else y - sum((c * x for c, x in zip(b, xs)), F.lit(0.0)))
        return F.when(y.isNotNull() if name == "c_reg" else full, out)

    def solved(self, s: list[Column], k: int) -> list[Column]:
        """The solution of the normal equations, by elimination: ``s`` has the upper triangle row by row, then the right side; NULL if singular."""
        upper = iter(s)
        left = [[None] * k for _ in range(k)]
        for i in range(k):
            for j in range(i, k):
                left[i][j] = left[j][i] = next(upper)
        right, det = list(upper), F.lit(1.0)
        for i in range(k):
            det = det * left[i][i]
            pivot = F.when(F.abs(left[i][i]) > 0, left[i][i])
            for r in range(i + 1, k):
                factor = self.keep(left[r][i] / pivot)
                left[r] = [None if c <= i else self.keep(left[r][c] - factor * left[i][c]) for c in range(k)]
                right[r] = self.keep(right[r] - factor * right[i])
        out: list = [None] * k
        for i in reversed(range(k)):
            rest = right[i]
            for c in range(i + 1, k):
                rest = rest - left[i][c] * out[c]
            out[i] = self.keep(F.when(F.abs(det) > 1e-100, rest / F.when(F.abs(left[i][i]) > 0, left[i][i])))
        return out


def evaluate(panel: DataFrame, expression: str, out: str = "value", mask: str | None = "univ") -> DataFrame:
    """(dti, ii, value): the expression on a dense panel, NULL outside the mask."""
    plan = Plan(panel, mask)
    c = plan.build(parse(expression))
    return plan.df.select(plan.date, plan.key, plan.masked(fin(c)).alias(out))
