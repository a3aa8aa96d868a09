"""Ratios with Wilson intervals."""

from pyspark.sql import functions as F

from groundwork import fixed


def wilson(k, n):
    """95% interval of k out of n as (low, high); NULL bounds when nothing was counted.

    Counts that cannot be (k above n, negatives) give NULL bounds too.
    """
    z2 = fixed.WILSON_Z * fixed.WILSON_Z
    k, n = k.cast("double"), n.cast("double")
    p = k / n
    divisor = 1 + z2 / n
    center = (p + z2 / (2 * n)) / divisor
    radius = fixed.WILSON_Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / divisor
    usable = (n > 0) & (k >= 0) & (k <= n)
    low = F.when(usable, F.greatest(F.lit(0.0), center - radius))
    high = F.when(usable, F.least(F.lit(1.0), center + radius))
    return F.struct(low.alias("low"), high.alias("high"))


def count_or_null(value):
    """A count as stored in an artifact: negatives are no count."""
    return F.when(value >= 0, value)


def interval_text(k, n):
    """``k/n [low%, high%]``, or ``not measured``."""
    k, n = count_or_null(k), count_or_null(n)
    bounds = wilson(k, n)
    text = F.format_string("%d/%d [%.1f%%, %.1f%%]", k, n, 100 * bounds["low"], 100 * bounds["high"])
    return F.when(k.isNotNull() & (n > 0) & (k <= n), text).otherwise("not measured")
