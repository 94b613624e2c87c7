"""Order statistics by radix selection: counts by leading bits, no sort and no range shuffle.

A double has an order-preserving 64-bit image. Rows are first counted per distinct image; every pass then counts
the next bits of the images that share a wanted prefix and follows each wanted rank into one of them. A pass is one
aggregation that is summed on the map side and holds 2^11 counts a prefix at most, so no task holds a group,
however large. Passes end early once every wanted prefix holds one value, as whole numbers do after two or three.

Counts may come in parts. A rank can be asked of all parts, of one, or of all but one: there the counts of a prefix are
the pooled ones less the part's own, so leaving each of many parts out needs no copy of any count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.scan import lookup
from riskloom.staging import stage

BITS, SHIFTS = 11, (55, 44, 33, 22, 11, 0)
ALL, ONLY, WITHOUT = "all", "only", "without"
_FRACTION, _BIAS = 1 << 52, 1023
_NAN = (1 << 63) - 1


def _power(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent.cast("double"))


def image(value: Column) -> Column:
    """A long that orders as the double does: negative for negative values, one zero, NaN last; null for null."""
    x = value.cast("double")
    a = F.abs(x)
    near = F.floor(F.log2(a))
    e = near + (a >= _power(near + 1)).cast("long") - (a < _power(near)).cast("long")  # the logarithm may be off by a bit
    normal = (e + _BIAS) * F.lit(_FRACTION) + ((a / _power(e) - 1) * F.lit(float(_FRACTION))).cast("long")
    tiny = (a * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("long")
    size = (F.when(a == 0, F.lit(0).cast("long")).when(a == F.lit(float("inf")), F.lit(2047 * _FRACTION))
            .when(a < F.lit(2.0 ** -1022), tiny).otherwise(normal))
    return F.when(F.isnan(x), F.lit(_NAN)).when(x < 0, -size).otherwise(F.when(x.isNotNull(), size))


def value(of: Column) -> Column:
    """The double of an image."""
    size = F.abs(of)
    e, fraction = F.shiftright(size, 52), size.bitwiseAND(F.lit(_FRACTION - 1)).cast("double")
    tiny = fraction * F.lit(2.0 ** -537) * F.lit(2.0 ** -537)
    a = (F.when(of == _NAN, F.lit(float("nan"))).when(e == 2047, F.lit(float("inf"))).when(e == 0, tiny)
         .otherwise((fraction / F.lit(float(_FRACTION)) + 1) * _power(e - _BIAS)))
    return F.when(of < 0, -a).otherwise(a)


def _follow(pooled: Column, own: Column, mode: Column, left: Column) -> Column:
    """(digit, left): the digit in whose counts the rank ``left`` falls, and the rank within; null digit beyond the last."""
    start = F.struct(F.lit(None).cast("long").alias("digit"), left.cast("long").alias("left"))

    def step(state: Column, entry: Column) -> Column:
        mine = F.coalesce(F.try_element_at(own, entry["digit"]), F.lit(0).cast("long"))
        n = F.when(mode == WITHOUT, entry["n"] - mine).when(mode == ONLY, mine).otherwise(entry["n"])
        here = state["digit"].isNull() & (state["left"] < n)
        return (F.when(state["digit"].isNotNull(), state)
                .when(here, F.struct(entry["digit"].alias("digit"), state["left"].alias("left")))
                .otherwise(F.struct(F.lit(None).cast("long").alias("digit"), (state["left"] - n).alias("left"))))

    return F.aggregate(pooled, start, step)


def order_statistics(counts: DataFrame, wanted: DataFrame, group: Sequence[str], part: str | None = None) -> DataFrame:
    """``wanted`` with ``value``, the value at ``rank`` (from 0) in the order of its group; rows beyond it are left out.

    ``counts`` has the columns of ``group``, ``part`` if named, ``image`` and ``n``, and is read once a pass: pass a stored
    table. With ``part``, ``wanted`` names a part and a ``mode``: ALL, ONLY or WITHOUT. Groups must not be null.
    """
    group = list(group)
    parts = [part] if part else []
    state = wanted.withColumns({"_prefix": F.lit(0).cast("long"), "_left": F.col("rank").cast("long")})
    if not part:
        state = state.withColumn("mode", F.lit(ALL))
    state = lookup(state)
    for turn, shift in enumerate(SHIFTS):
        prefix = F.shiftright("image", shift + BITS) if turn else F.lit(0).cast("long")
        digit = F.shiftright("image", shift)
        digits = counts.withColumns({"_prefix": prefix, "digit": digit.bitwiseAND(F.lit(2 ** BITS - 1)) if turn else digit})
        if turn:
            digits = digits.join(state.select(*group, "_prefix"), [*group, "_prefix"], "left_semi")
        seen = stage(digits.groupBy(*group, *parts, "_prefix", "digit").agg(
            F.sum("n").alias("n"), F.min("image").alias("low"), F.max("image").alias("high")), "digits")
        pooled = seen.groupBy(*group, "_prefix", "digit").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
        ).groupBy(*group, "_prefix").agg(F.array_sort(F.collect_list(F.struct("digit", "n", "low", "high"))).alias("_pooled"))
        state = state.join(pooled, [*group, "_prefix"])
        if part:
            own = seen.groupBy(*group, part, "_prefix").agg(
                F.map_from_entries(F.collect_list(F.struct("digit", "n"))).alias("_own"))
            state = state.join(own, [*group, part, "_prefix"], "left")
        else:
            state = state.withColumn("_own", F.lit(None).cast("map<bigint,bigint>"))
        state = state.withColumn("_at", _follow(F.col("_pooled"), F.col("_own"), F.col("mode"), F.col("_left"))).where(
            "_at.digit IS NOT NULL").withColumn("_entry", F.filter("_pooled", lambda x: x["digit"] == F.col("_at.digit"))[0])
        state = lookup(state.withColumns({
            "_prefix": F.shiftleft("_prefix", BITS) + F.col("_at.digit") if turn else F.col("_at.digit"),
            "_left": F.col("_at.left"), "_low": F.col("_entry.low"), "_high": F.col("_entry.high"),
        }).drop("_at", "_entry", "_pooled", "_own"))
        if shift == 0 or state.where("_low < _high").isEmpty():
            break
        state = state.drop("_low", "_high")
    out = state.withColumn("value", value(F.col("_low"))).drop("_prefix", "_left", "_low", "_high")
    return out if part else out.drop("mode")


def ranks(size: Column, probabilities: dict[str, float]) -> Column:
    """(name, rank, share) structs: the neighbours of each interpolated quantile among ``size`` values, with their shares."""
    entries = []
    for name, p in probabilities.items():
        at = (size - 1) * F.lit(float(p))
        low = F.floor(at).cast("long")
        for rank, share in ((low, 1 - (at - low)), (low + 1, at - low)):
            entries.append(F.struct(F.lit(name).alias("name"), rank.alias("rank"), share.alias("share")))
    return F.filter(F.array(*entries), lambda x: x["share"] > 0)


def interpolated(found: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One column per quantile from the rows of ``order_statistics`` over exploded ``ranks``."""
    low, high, share = F.min("value"), F.max("value"), F.max_by("share", "rank")
    each = found.groupBy(*keys, "name").agg(
        F.when(F.count(F.lit(1)) == 1, low).otherwise(low + (high - low) * share).alias("value"))
    return each.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])


def images(df: DataFrame, group: Sequence[str], column: str, weight: str | None = None) -> DataFrame:
    """(group, image, n) of the values of ``column`` that are not null: counted first, so an image is taken per value, not per row."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*group, F.col(column).cast("double").alias("_value")).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    return counts.select(*group, image(F.col("_value")).alias("image"), "n")


def quantiles(df: DataFrame, group: Sequence[str], column: str, probabilities: dict[str, float],
              weight: str | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per name. Null values are left out, NaN is largest."""
    if not group:
        return quantiles(df.withColumn("_all", F.lit(0)), ["_all"], column, probabilities, weight).drop("_all")
    group = list(group)
    counts = stage(images(df, group, column, weight), "images")
    wanted = counts.groupBy(*group).agg(F.sum("n").alias("_size")).select(
        *group, F.inline(ranks(F.col("_size"), probabilities)))
    return interpolated(order_statistics(counts, wanted, group), group, list(probabilities))
