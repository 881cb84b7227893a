"""Ledgers: event-ordered, idempotent, with time limits. Batch forms over event tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Cols = list[str]


def month_balance(events: DataFrame, owner: Cols, at: str, order: Cols, spent: str, grant: int) -> DataFrame:
    """events with month and remaining: each UTC month begins with the grant, nothing rolls over."""
    df = events.withColumn("month", F.date_format(at, "yyyy-MM"))
    return df.withColumn("remaining", F.lit(grant) - F.sum(spent).over(Window.partitionBy(*owner, "month").orderBy(*order)))


def expired(reservations: DataFrame, at: str, now: Column, seconds: int) -> DataFrame:
    """Reservations to release: at least so old, or without a readable time."""
    return reservations.filter(F.col(at).isNull() | (F.unix_timestamp(now) - F.unix_timestamp(at) >= seconds))


def charged_once(events: DataFrame, key: Cols, order: Cols) -> DataFrame:
    """The first event of each charge id; the others are replays and cost nothing."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def grouped_charges(steps: DataFrame, job: Cols, order: Cols, per_step: int = 1, pair: int = 2) -> DataFrame:
    """Per job its steps and charges: one a step, and one for every two steps begun."""
    at = F.row_number().over(Window.partitionBy(*job).orderBy(*order)) - 1
    return steps.withColumn("_i", at).groupBy(*job).agg(F.count(F.lit(1)).alias("n_steps"), (per_step * F.count(F.lit(1)) + F.count_distinct(F.floor(F.col("_i") / pair))).alias("n_charges"))


def anchored_limit(failures: DataFrame, owner: Cols, at: str, order: Cols, seconds: int = 900, most: int = 5) -> DataFrame:
    """failures with window_start and n_in_window, of windows that begin at the first failure outside the last one; blocked at `most`.

    A window's start depends on the one before, so an owner's failures are folded in order, batch by batch, a step a window.
    """
    w = Window.partitionBy(*owner).orderBy(at, *order)
    use = failures.withColumns({"_t": F.unix_timestamp(at).cast("long"), "_first": F.row_number().over(w) == 1})  # in order, owner by owner
    schema = StructType([*failures.schema.fields, *StructType.fromDDL("window_start long, n_in_window long").fields])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, n = 0, 0  # of the window that is open: all that is kept of what came before
        for b in batches:
            t, first = b.column("_t").to_numpy(), b.column("_first").to_numpy(zero_copy_only=False)
            starts, counts = np.empty(len(t), np.int64), np.empty(len(t), np.int64)
            heads = np.flatnonzero(first)
            for lo, hi in zip([0, *heads], [*heads, len(t)], strict=True):
                open_ = not (lo < len(t) and first[lo])
                while lo < hi:
                    start, n = (start, n) if open_ else (int(t[lo]), 0)
                    end = lo + int(np.searchsorted(t[lo:hi], start + seconds))
                    starts[lo:end], counts[lo:end] = start, np.arange(n + 1, n + 1 + end - lo)
                    lo, n, open_ = end, n + end - lo, False
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(starts), pa.array(counts)], names=[*b.schema.names[:-2], "window_start", "n_in_window"])

    return use.mapInArrow(fold, schema).withColumn("blocked", F.col("n_in_window") >= most)


def applied_subscriptions(transactions: DataFrame, wallet: Cols, transaction: str, order: Cols, plan_credits: Column) -> DataFrame:
    """Credits after each new transaction id (a renewal resets them to the plan's); replays change nothing."""
    df = charged_once(transactions, [*wallet, transaction], order)
    return df.withColumn("credits", plan_credits).withColumn("grant_no", F.row_number().over(Window.partitionBy(*wallet).orderBy(*order)))


def balance_and_debt(events: DataFrame, wallet: Cols, order: Cols, amount: str) -> DataFrame:
    """events with remaining and debt: grants pay debt first, refunds beyond what remains make debt."""
    df = events.withColumn("_net", F.sum(amount).over(Window.partitionBy(*wallet).orderBy(*order)))
    return df.withColumns({"remaining": F.greatest(F.lit(0), F.col("_net")), "debt": F.greatest(F.lit(0), -F.col("_net"))}).drop("_net")


def chosen_source(sources: DataFrame, owner: Cols, expires: str, rank: str, remaining: str) -> DataFrame:
    """The credits to spend: earliest to expire (never last), then by rank, of those with any left."""
    w = Window.partitionBy(*owner).orderBy(F.col(expires).asc_nulls_last(), rank)
    return sources.filter(F.col(remaining) > 0).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def last_status(events: DataFrame, key: Cols, order: Cols, status: str) -> DataFrame:
    return events.groupBy(*key).agg(F.max_by(status, F.struct(*order)).alias(status))


def combined_credits(sources: DataFrame, owner: Cols, kind: str, remaining: str) -> DataFrame:
    left = F.col(remaining)
    return sources.groupBy(*owner).agg(F.sum(left).cast("long").alias("total"), F.sum(F.when(F.col(kind) == "purchased", left).otherwise(0)).cast("long").alias("purchased"), F.bool_or(left > 0).alias("any_left"))


def subscription_active(status: Column, now: Column, expiry: Column, grace: Column, terminal: tuple[str, ...] = ("refunded", "revoked", "expired", "inactive")) -> Column:
    """Whether a subscription holds: not ended, and before its expiry or, while billing is in grace, the grace's end."""
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return ~s.isin(*terminal) & (F.coalesce(now < expiry, F.lit(False)) | ((s == "billing_grace") & F.coalesce(now < grace, F.lit(False))))
