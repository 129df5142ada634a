"""Statistics that training runs keep as JSON arrays, one object for each epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPOCHS = "array<struct<epoch: int, train_loss: double, val_loss: double, learning_rate: double, timestamp: string>>"


def epochs(stats: DataFrame) -> DataFrame:
    """(run, position, epoch, train_loss, val_loss, learning_rate, timestamp) of stats(run, body); no rows for a broken body."""
    return stats.select("run", F.posexplode(F.from_json("body", EPOCHS)).alias("position", "e")).select("run", "position", "e.*")


def summary(rows: DataFrame) -> DataFrame:
    """One row for each run of epochs(): last and best losses, what they gained since the first epoch, and how far apart they are.

    The best epoch counts from 1 in the order of the array, the earliest of equal ones; shares of a zero loss are null.
    """
    last = lambda c: F.max_by(c, "position")
    first = lambda c: F.min_by(c, "position")
    share = lambda a, b: F.when(b != 0, a / b)
    best = F.min(F.when(F.col("val_loss").isNotNull(), F.struct("val_loss", "position")))
    per = rows.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_epochs"), last("train_loss").alias("final_train_loss"), last("val_loss").alias("final_val_loss"), last("learning_rate").alias("final_lr"),
        best.alias("best"), first("train_loss").alias("t0"), first("val_loss").alias("v0"),
    )
    t, v = F.col("final_train_loss"), F.col("final_val_loss")
    return per.select(
        "run", "n_epochs", "final_train_loss", "final_val_loss", "final_lr", F.col("best.val_loss").alias("best_val_loss"), (F.col("best.position") + 1).alias("best_epoch"),
        share(F.col("t0") - t, F.col("t0")).alias("train_loss_improvement"), share(F.col("v0") - v, F.col("v0")).alias("val_loss_improvement"),
        (v - t).alias("val_train_gap"), share(v, t).alias("overfit_ratio"),
    )
