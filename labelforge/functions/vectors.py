"""Array-column math: slices, argmax, L2 normalisation, log-softmax.

Higher-order functions (``transform``/``aggregate``) keep these in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelforge.functions.text import col_


def elements(c, start: int, count: int) -> Column:
    """``count`` elements from 1-based position ``start`` as ARRAY<DOUBLE>."""
    return F.transform(F.slice(col_(c), start, count), lambda x: x.cast("double"))


def argmax(c) -> Column:
    """0-based index of the largest element; the first one on ties."""
    c = col_(c)
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def sum_of_squares(c) -> Column:
    return F.aggregate(col_(c), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_norm(c) -> Column:
    return F.sqrt(sum_of_squares(c))


def l2_normalize(c, eps: float = 1e-12) -> Column:
    """``v / max(||v||, eps)`` element-wise (zero vectors stay zero)."""
    c = col_(c)
    norm = F.greatest(l2_norm(c), F.lit(eps))
    return F.transform(c, lambda x: x.cast("double") / norm)


def log_sum_exp(c) -> Column:
    c = col_(c)
    m = F.array_max(c)
    return m + F.log(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))


def log_softmax_at(c, index) -> Column:
    """``log p_index`` of a softmax over the logits array (0-based index)."""
    c = col_(c)
    return F.get(c, col_(index)) - log_sum_exp(c)
