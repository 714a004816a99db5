"""Training-curve operators.

An epoch series is a table ``(run_id, epoch, train_loss, train_acc,
val_loss, val_acc, learning_rate)``.  Running minima and "last improvement"
positions come from one staged pass bucketed by (run, epoch block) (see
``ranking``), so a run with a huge number of epochs is still spread over
many tasks.  Per-run reductions are
``min_by`` / ``max_by`` hash aggregates (map-side combined).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelforge import spec
from labelforge.operators import ranking as rk
from labelforge.session import materialize

EPOCH_BUCKET = 1024


def _bucket(epoch_col: str = "epoch"):
    # A null epoch has a block of its own, before the others.
    return F.coalesce(F.floor(F.col(epoch_col) / EPOCH_BUCKET).cast("bigint"), F.lit(-1))


def batch_weighted_metrics(batches: DataFrame, group_cols: list[str], loss_col: str,
                           correct_col: str, n_col: str) -> DataFrame:
    """Sample-weighted mean loss and accuracy: sum(loss*n)/sum(n), sum(correct*n)/sum(n)."""
    n = F.col(n_col).cast("double")
    return batches.groupBy(*group_cols).agg(
        F.try_divide(F.sum(F.col(loss_col) * n), F.sum(n)).alias("loss"),
        F.try_divide(F.sum(F.col(correct_col).cast("double") * n), F.sum(n)).alias("acc"),
        F.sum(F.col(n_col)).cast("bigint").alias("n_samples"),
    )


def no_improvement(series: DataFrame, run_col: str = "run_id", epoch_col: str = "epoch",
                   loss_col: str = "val_loss") -> DataFrame:
    """Add ``improved`` and ``no_improve``: epochs since the last strict
    improvement of ``loss_col`` (0 on an improving epoch).

    One staged pass (rows dealt by (run, epoch block)).  Per block, one
    aggregate gives the block minimum and the first epoch reaching it; on
    that small table, the minimum of earlier blocks and the last improving
    epoch before the block follow from windows: a block improves only if its
    minimum beats every earlier block, and then its last improvement is the
    first epoch at that minimum.  Two windows inside the block finish the
    row values.
    """
    inf = F.lit(float("inf"))
    loss, epoch = F.col(loss_col), F.col(epoch_col)
    s, pk = rk._group_key(series.withColumn("_lf_eb", _bucket(epoch_col)), [run_col])
    keys = pk + ["_lf_eb"]
    staged = rk._materialized(s)
    per = staged.groupBy(*keys).agg(F.min(loss).alias("_lf_bmin"),
                                    F.min_by(epoch, F.struct(loss, epoch)).alias("_lf_barg"))
    before = Window.partitionBy(*pk).orderBy("_lf_eb").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_lf_cmin", F.min("_lf_bmin").over(before))
    per = per.withColumn("_lf_blast", F.when(F.col("_lf_bmin") < F.coalesce(F.col("_lf_cmin"), inf),
                                             F.col("_lf_barg")))
    carry = per.select(*keys, "_lf_cmin", F.max("_lf_blast").over(before).alias("_lf_clast"))
    rows = staged.join(carry, keys, "inner")
    in_block = Window.partitionBy(*keys).orderBy(epoch_col)
    rows = rows.withColumn("_lf_lmin", F.min(loss).over(in_block.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("improved", loss < F.coalesce(F.least(F.col("_lf_cmin"), F.col("_lf_lmin")), inf))
    rows = rows.withColumn("_lf_llast", F.max(F.when(F.col("improved"), epoch)).over(
        in_block.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.greatest(F.col("_lf_clast"), F.col("_lf_llast"))
    out = rows.withColumn("no_improve", (epoch - F.coalesce(last, F.lit(-1))).cast("bigint"))
    return out.drop("_lf_eb", "_lf_cmin", "_lf_clast", "_lf_lmin", "_lf_llast", *pk)


def early_stop_epochs(flagged: DataFrame, patience: int = spec.PATIENCE, run_col: str = "run_id",
                      epoch_col: str = "epoch") -> DataFrame:
    """First epoch per run whose counter reached ``patience`` (runs that never
    stop are absent)."""
    return flagged.where(F.col("no_improve") >= patience).groupBy(run_col) \
        .agg(F.min(epoch_col).alias("stop_epoch"))


def truncate_at_stop(flagged: DataFrame, stops: DataFrame, run_col: str = "run_id",
                     epoch_col: str = "epoch") -> DataFrame:
    """Epochs that actually ran: everything up to and including the stop."""
    j = flagged.join(stops, run_col, "left")
    return j.where(F.col("stop_epoch").isNull() | (F.col(epoch_col) <= F.col("stop_epoch")))


def ran_epochs(series: DataFrame, patience: int = spec.PATIENCE, run_col: str = "run_id",
               epoch_col: str = "epoch", loss_col: str = "val_loss") -> DataFrame:
    """Flagged epochs up to the early stop; the flagged series feeds both the
    stop search and the cut, so it is written once."""
    flagged = materialize(no_improvement(series, run_col, epoch_col, loss_col))
    stops = early_stop_epochs(flagged, patience, run_col, epoch_col)
    return truncate_at_stop(flagged, stops, run_col, epoch_col)


def best_epoch(ran: DataFrame, run_col: str = "run_id", epoch_col: str = "epoch",
               loss_col: str = "val_loss") -> DataFrame:
    """First strict minimum of the validation loss and the metrics there."""
    key = F.struct(F.col(loss_col), F.col(epoch_col))
    return ran.groupBy(run_col).agg(
        F.min_by(epoch_col, key).alias("best_epoch"),
        F.min_by(loss_col, key).alias("best_val_loss"),
        F.min_by("val_acc", key).alias("best_val_acc"),
        F.min_by("learning_rate", key).alias("best_learning_rate"),
    )


def run_summary(ran: DataFrame, patience: int = spec.PATIENCE, run_col: str = "run_id",
                epoch_col: str = "epoch", loss_col: str = "val_loss") -> DataFrame:
    """Epochs run, whether early stopping fired, last-epoch metrics and the
    best-epoch metrics, per run."""
    key = F.struct(F.col(loss_col), F.col(epoch_col))
    last = F.col(epoch_col)
    return ran.groupBy(run_col).agg(
        F.count(F.lit(1)).alias("epochs_ran"),
        F.max(F.col("no_improve") >= patience).alias("early_stop_triggered"),
        F.max_by("train_loss", last).alias("last_train_loss"),
        F.max_by("train_acc", last).alias("last_train_acc"),
        F.max_by("val_loss", last).alias("last_val_loss"),
        F.max_by("val_acc", last).alias("last_val_acc"),
        F.min_by(epoch_col, key).alias("best_epoch"),
        F.min_by(loss_col, key).alias("best_val_loss"),
        F.min_by("val_acc", key).alias("best_val_acc"),
    )


def epoch_lookup(points: DataFrame, series: DataFrame, value_cols: list[str], run_col: str = "run_id",
                 epoch_col: str = "epoch") -> DataFrame:
    """``series[epoch]`` with a bounds check, as a left equi-join on
    (run, epoch): an epoch outside the series gives null."""
    s = series.select(run_col, epoch_col, *value_cols)
    return points.join(s, [run_col, epoch_col], "left")
