"""Positions from a signal by thresholds, and numpy functions over trailing windows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import fin


def positions(panel: DataFrame, algo: int, thd: float, hold: float = 0.0) -> DataFrame:
    """``panel`` (dti, ii, value) with the position that ``value`` asks for.

    0: one, zero or minus one beyond ``thd``; 1: value / thd within -1 and 1; 2: a position of
    one beyond ``thd`` that stays while the value is beyond ``hold``; 3: as 2, and between
    0 and ``hold`` it halves with every row.  A missing value is missing and ends a position.

    A row beyond ``thd`` starts a run whatever came before, and every later row either
    keeps, halves or ends what the run holds; so a position is the run's sign, the
    halvings since, and whether a row has ended it: counts inside the run.
    """
    x = fin(F.col("value"))
    if algo == 0:
        return panel.withColumn("value", F.when(x >= thd, 1.0).when(x <= -thd, -1.0).when(x.isNotNull(), 0.0))
    if algo == 1:
        return panel.withColumn("value", F.when(x.isNotNull(), F.greatest(F.least(x / thd, F.lit(1.0)), F.lit(-1.0))))
    if algo not in (2, 3):
        raise ValueError(f"no algorithm {algo}")
    kept, starts = panel.columns, F.when(x <= -thd, -1.0).when(x >= thd, 1.0)
    df = panel.withColumn("_start", starts)
    line = Window.partitionBy("ii").orderBy("dti").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_run", F.count("_start").over(line))
    run = Window.partitionBy("ii", "_run")
    df = df.withColumn("_sign", F.max("_start").over(run))
    along = x * F.col("_sign")
    stays = F.col("_start").isNotNull() | (along > hold)
    halves = ~stays & (along > 0) if algo == 3 else F.lit(False)
    so_far = run.orderBy("dti").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_ended", F.coalesce(~(stays | halves), F.lit(True)).cast("int")).withColumn("_halved", F.coalesce(halves, F.lit(False)).cast("int"))
    df = df.withColumn("_ends", F.sum("_ended").over(so_far)).withColumn("_halvings", F.sum("_halved").over(so_far))
    held = F.when((F.col("_run") > 0) & (F.col("_ends") == 0), F.col("_sign") * F.pow(F.lit(0.5), F.col("_halvings"))).otherwise(0.0)
    return df.withColumn("value", F.when(x.isNotNull(), held)).select(kept)


def rolled(panel: DataFrame, function: Callable[[np.ndarray], np.ndarray], rows: int, block: int = 4096, mask: str | None = None, fill: bool = False) -> DataFrame:
    """(dti, ii, value): ``function`` of the last ``rows`` cells of ``value``, for each row that has so many.

    ``function`` takes a matrix with a window per row and gives a number for each.  An
    instrument's rows are dealt to blocks by their number, and the last rows of a block go
    to the next one too; so a task holds a block, not a history.  Missing cells are NaN, or 0
    with ``fill``; ``mask`` names a Boolean column of the rows that want a value.
    """
    if block < rows:
        raise ValueError("a block takes at least a window")
    wanted = F.coalesce(F.col(mask), F.lit(False)) if mask else F.lit(True)
    df = panel.select("dti", "ii", fin(F.col("value").cast("double")).alias("x"), wanted.alias("wanted"))
    df = df.withColumn("t", F.row_number().over(Window.partitionBy("ii").orderBy("dti")) - 1)
    own = F.floor(F.col("t") / block)
    # rows near the end of a block are read by the next one as well
    spread = F.when(F.col("t") % block > block - rows, F.array(own, own + 1)).otherwise(F.array(own))
    df = df.withColumn("block", F.explode(spread))

    def windows(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        x = part["x"].to_numpy(float)
        if fill:
            x = np.nan_to_num(x, nan=0.0)
        t, mine = part["t"].to_numpy(), (part["t"] // block == key[1]).to_numpy()
        value = np.full(len(x), np.nan)
        if len(x) >= rows:
            here = np.arange(rows - 1, len(x))
            here = here[mine[here] & part["wanted"].to_numpy()[here] & (t[here] >= rows - 1)]
            value[here] = function(np.lib.stride_tricks.sliding_window_view(x, rows)[here - rows + 1])
        return pd.DataFrame({"dti": part["dti"], "ii": part["ii"], "value": value})[mine]

    kinds = dict(panel.dtypes)
    out = df.groupBy("ii", "block").applyInPandas(windows, f"dti {kinds['dti']}, ii {kinds['ii']}, value double")
    return out.withColumn("value", fin(F.when(~F.isnan("value"), F.col("value"))))
