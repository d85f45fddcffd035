"""Scalar rules on numbers: costs, estimates, bands, guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Prices are per 1000 tokens; 0 where there is no price."""
    return F.coalesce(tokens_in / 1000 * price_in + tokens_out / 1000 * price_out, F.lit(0.0))


def band(value: Column, limits: list[tuple[float, str]], otherwise: str, strict: bool = True) -> Column:
    """The label of the first limit that ``value`` is above (or at, if not strict)."""
    out = None
    for limit, label in limits:
        hit = value > limit if strict else value >= limit
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def topic_estimate(tokens: Column, rows: Column, *, keyword_mode: bool = False) -> Column:
    """How many topics a text of so many tokens and rows is asked for."""
    per, tops, shares, step = (0.6, (800, 400), (1.1, 1.0, 0.9), 10) if keyword_mode else (0.8, (1000, 500), (1.2, 1.0, 0.8), 8)
    weight = 0.6 if keyword_mode else 0.7
    density = F.when(rows > tops[0], shares[0]).when(rows > tops[1], shares[1]).otherwise(shares[2])
    by_tokens = F.floor(tokens / 1000 * per * density)
    by_rows = F.floor(rows / step)
    return F.greatest(F.lit(3), F.floor(by_tokens * weight + by_rows * (1 - weight) + 1e-9)).cast("bigint")


def expected_output(rows: Column) -> Column:
    return F.least(F.lit(10000), F.greatest(F.lit(1000), rows * 50)).cast("bigint")


def sample_size(n: Column) -> Column:
    """A tenth of 1000 rows or more, 15 % of 500 or more, else a fifth; from 50 to 500."""
    share = F.when(n >= 1000, F.floor(n * 0.10)).when(n >= 500, F.floor(n * 0.15)).otherwise(F.floor(n * 0.20))
    return F.least(F.lit(500), F.greatest(F.lit(50), share)).cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0 or null."""
    return F.when(b != 0, a / b).otherwise(0.0)


def split_sizes(n_train: Column, n_test: Column, wanted: Column, test_share: float) -> Column:
    """struct<train, test>: ``wanted`` test rows (at most all) and as many training rows as keep the share; where these are too few, all of them and a smaller test set."""
    test = F.least(n_test, wanted)
    train = F.floor(test / F.lit(test_share) * F.lit(1 - test_share) + 1e-9)
    fewer = F.floor(n_train / F.lit(1 - test_share) * F.lit(test_share) + 1e-9)
    return F.when(train > n_train, F.struct(n_train.cast("bigint").alias("train"), fewer.cast("bigint").alias("test"))).otherwise(F.struct(train.cast("bigint").alias("train"), test.cast("bigint").alias("test")))


def side_bias(side: Column, middle: Column) -> Column:
    return F.when(side > middle * 1.5, "high").when(side > middle, "medium").otherwise("low")


def neglect_band(middle: Column, front: Column) -> Column:
    return F.when(middle < front * 0.5, "severe").when(middle < front * 0.8, "medium").otherwise("slight")


def balance_band(balance: Column) -> Column:
    return F.when(balance < 0.1, "balanced").when(balance < 0.2, "slight preference").otherwise("clear preference")


def estimate_band(share: Column) -> Column:
    """How near the made topics come to the model's own estimate."""
    return F.when(share.between(0.8, 1.2), "accurate").when(share < 0.8, "overestimated").otherwise("underestimated")


def diversity_bands(diversity: Column, redundancy: Column, fewer: Column) -> dict[str, Column]:
    good = F.when(diversity >= 0.8, "excellent").when(diversity >= 0.6, "good").when(diversity >= 0.4, "fair").otherwise("poor")
    overall = F.when((diversity >= 0.7) & (redundancy <= 0.2), "excellent").when((diversity >= 0.5) & (redundancy <= 0.4), "good").otherwise("to improve")
    return {
        "quality": good, "redundancy_band": F.when(redundancy <= 0.1, "slight").when(redundancy <= 0.3, "medium").otherwise("severe"),
        "compression_band": F.when(fewer <= 5, "low").when(fewer <= 15, "medium").otherwise("high"), "overall": overall,
    }


def advice(mean: Column) -> Column:
    """What a report says about a mean score of 1 to 5."""
    return F.when(mean >= 4, "keep").when(mean >= 3, "refine").when(mean >= 2, "improve weak criteria").otherwise("make anew")
