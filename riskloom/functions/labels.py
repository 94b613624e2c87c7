"""Column expressions that turn numbers into labels and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.schemas import ATTENTION_RATES, CONTRIBUTION_EPSILON, RISK_BAND_EDGES


def snap(contribution: Column) -> Column:
    """Contributions within the epsilon count as zero."""
    return F.when(F.abs(contribution) <= CONTRIBUTION_EPSILON, F.lit(0.0)).otherwise(contribution)


def direction(contribution: Column) -> Column:
    return (
        F.when(contribution > 0, "increases_risk")
        .when(contribution < 0, "decreases_risk")
        .otherwise("neutral")
    )


def predicted(score: Column, threshold: Column) -> Column:
    return (score >= threshold).cast("int")


def attention_level(high: Column, total: Column) -> Column:
    bad = (high < 0) | (total < 0) | (high > total)
    rate = high / total
    return (
        F.when(bad, F.raise_error(F.lit("attention level needs 0 <= high <= total")))
        .when(high == 0, "LOW")
        .when(rate < ATTENTION_RATES[0], "MODERATE")
        .when(rate < ATTENTION_RATES[1], "ELEVATED")
        .otherwise("HIGH")
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def percentage(part: Column, whole: Column) -> Column:
    return ratio_or_zero(part, whole) * 100.0


def edge_index(score: Column, edges: list[float]) -> Column:
    """Number of inner edges at or below the score: left-closed bins, last bin closed."""
    index = F.lit(0)
    for edge in edges[1:-1]:
        index = index + (score >= F.lit(edge)).cast("int")
    return index


def risk_band(score: Column) -> Column:
    return edge_index(score, RISK_BAND_EDGES)


def bin_edges(bins: int) -> list[float]:
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def sigmoid(margin: Column) -> Column:
    """Logistic function; a hugely negative margin gives exp() = infinity and the score 0."""
    return 1.0 / (1.0 + F.exp(-margin))


def sign_word(total: Column, positive: str, negative: str, zero: str) -> Column:
    return F.when(total > 0, positive).when(total < 0, negative).otherwise(zero)
