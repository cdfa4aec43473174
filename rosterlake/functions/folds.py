"""Folds over arrays whose every state is kept, linear in the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def scanned(xs: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str, *, block: int = 256) -> Column:
    """The state behind each member of a fold that begins with zero; `kind` is the state's SQL type.

    An array is copied when it grows, so members are folded in blocks, and the blocks' arrays are put side by side at the end.
    """
    zero = zero.cast(kind)

    def of_block(members: Column, state: Column) -> Column:
        grown = lambda acc, x: let(step(acc["s"], x), lambda s: F.struct(s.cast(kind).alias("s"), F.array_append(acc["out"], s.cast(kind)).alias("out")))
        return F.aggregate(members, F.struct(state.alias("s"), F.array().cast(f"array<{kind}>").alias("out")), grown)

    def whole(all_: Column) -> Column:
        starts = F.when(F.size(all_) > 0, F.sequence(F.lit(1), F.size(all_), F.lit(block))).otherwise(F.array().cast("array<int>"))
        start = F.struct(zero.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        grown = lambda acc, i: let(of_block(F.slice(all_, i, F.lit(block)), acc["s"]), lambda r: F.struct(r["s"].alias("s"), F.array_append(acc["out"], r["out"]).alias("out")))
        return F.aggregate(starts, start, grown, lambda acc: F.flatten(acc["out"]))

    return let(xs, whole)
