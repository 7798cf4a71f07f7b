"""Functions on codes and on probability arrays with one slot per code 0..10."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fogbank import constants as K
from fogbank.functions.text import ColumnLike, col


def is_fog(code: ColumnLike) -> Column:
    return col(code).between(K.FIRST_FOG_CODE, K.LAST_FOG_CODE)


def code_name(code: ColumnLike) -> Column:
    c = col(code)
    names = F.create_map(*[F.lit(x) for pair in {0: K.NO_PHENOMENON, **K.CODE_NAMES}.items()
                           for x in pair])
    return F.coalesce(F.try_element_at(names, c.cast("int")),
                      F.concat(F.lit("コード"), c.cast("string")))


def percent(probability: ColumnLike) -> Column:
    return F.bround(col(probability) * 100, 1)


def verdict(probability: ColumnLike, threshold: ColumnLike) -> Column:
    return F.when(F.coalesce(col(probability) >= col(threshold), F.lit(False)),
                  F.lit(K.FOG_VERDICT)).otherwise(F.lit(K.NO_VERDICT))


def slot(probabilities: ColumnLike, code: int) -> Column:
    return F.get(col(probabilities), F.lit(code))


def blend(forest: ColumnLike, boosted: ColumnLike, weight: ColumnLike | float) -> Column:
    """Slot-wise ``w * forest + (1 - w) * boosted``."""
    w = F.lit(weight) if isinstance(weight, (int, float)) else col(weight)
    return F.array(*[w * slot(forest, i) + (1 - w) * slot(boosted, i)
                     for i in range(K.CODE_SLOTS)])


def best_code(probabilities: ColumnLike) -> Column:
    """Code of the largest slot, the lowest code on a tie."""
    p = col(probabilities)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def fog_probability(probabilities: ColumnLike) -> Column:
    """Sum over the fog slots, low code first."""
    total = F.lit(0.0)
    for i in range(K.FIRST_FOG_CODE, K.LAST_FOG_CODE + 1):
        total = total + slot(probabilities, i)
    return total
