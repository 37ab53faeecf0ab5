"""Folds over long arrays whose cost grows with the array, not with its square."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def let(x: Column, of: Callable[[Column], Column]) -> Column:
    """of(x), with x evaluated once."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def scan(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], element: str, block: int = BLOCK) -> Column:
    """What step says for all items in order, as one array<element>; null for null items.

    step takes the state (first start) and an item and gives the next state and an array<element>. A fold that
    appends to one array copies it at every step; here every block of items has an array of its own.
    """
    none, nothing = F.expr(f"cast(array() as array<{element}>)"), F.expr(f"cast(array() as array<array<{element}>>)")
    pair = lambda state, out: F.struct(state.alias("state"), out.alias("out"))

    def one(s: Column, x: Column) -> Column:
        state, said = step(s["state"], x)
        return pair(state, F.concat(s["out"], said))

    def whole(xs: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(xs), F.lit(block))
        of = lambda s, i: let(F.aggregate(F.slice(xs, i, F.lit(block)), pair(s["state"], none), one), lambda b: pair(b["state"], F.concat(s["out"], F.array(b["out"]))))
        return F.flatten(F.aggregate(firsts, pair(start, nothing), of, lambda s: s["out"]))

    return let(items, lambda xs: F.when(F.size(xs) > 0, whole(xs)).when(xs.isNotNull(), none))


def before(sizes: Column) -> Column:
    """The sum of all elements before each, as array<bigint>."""
    return scan(sizes, F.lit(0).cast("long"), lambda at, x: ((at + x).cast("long"), F.array(at)), "bigint")
