"""Exact quantiles, sign flips and step-down adjustment."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veraline.operators.ordering import keyed_totals, running_totals
from veraline.plans.store import materialize

#: Cells of the histogram of sums that the driver holds.
MOST_SUMS = 4_000_000


def type7_quantile(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, tuple[int, int]]) -> DataFrame:
    """Linear-interpolation quantiles of whole numbers, each at num / den; whole-number arithmetic until one last division.

    Ranks come from range partitions, so a key may hold all rows.
    """
    own = rows.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("vl_k"), F.col(value).alias("vl_v"))
    ranked = keyed_totals(own, "vl_k", ["vl_v"], {}, "ranks")
    n = F.col("vl_m")
    counts = materialize(own.groupBy(F.col("vl_k").alias("vl_j")).agg(F.count("*").alias("vl_m")), "counts")
    sized = ranked.join(counts, F.col("vl_k").eqNullSafe(F.col("vl_j")))
    out = []
    for name, (num, den) in quantiles.items():
        at = (n - 1) * num
        low = F.max(F.when(F.col("position") == F.floor(at / den), F.col("vl_v")))
        high = F.max(F.when(F.col("position") == F.ceil(at / den), F.col("vl_v")))
        out.append((low + (high - low) * (F.first(at) % den) / F.lit(den)).alias(name))
    return sized.groupBy("vl_k").agg(*out).select("vl_k.*", *quantiles)


def _fewest(sizes: dict[int, int], top: int) -> int:
    """How many sign patterns have pluses whose sizes add up to `top` at most.

    The patterns by that sum are the coefficients c of P = product of (1 + y^s)^n.  From
    y P' / P = sum of n s y^s / (1 + y^s) follows, with D the product of all 1 + y^s and A
    the sum over D,  k c_k = sum over i of (A_i - D_i (k - i)) c_(k-i).  So each coefficient comes
    from the last few, as many as the different sizes add up to, and no others are held.
    """
    shared, most = [1], [0]
    for s, n in sizes.items():
        wide = [0] * (len(shared) + s)
        for i, (d, a) in enumerate(zip(shared, most, strict=True)):
            wide[i] += a
            wide[i + s] += a + n * s * d
        shared, most = [d + e for d, e in zip(shared + [0] * s, [0] * s + shared, strict=True)], wide
    terms = [(i, d, a) for i, (d, a) in enumerate(zip(shared, most, strict=True)) if i and (d or a)]
    last, total = deque([1], maxlen=len(shared) - 1), 1
    for k in range(1, top + 1):
        last.appendleft(sum((a - d * (k - i)) * last[i - 1] for i, d, a in terms if i <= min(k, len(last))) // k)
        total += last[0]
    return total if top >= 0 else 0


def _folded(sizes: dict[int, int], least: int) -> int:
    """How many sign patterns have a total of `least` or more, from a histogram of sums into which each size's binomial counts are folded."""
    sums = {0: 1}
    for size, n in sizes.items():
        ways, k = [1], 0
        while k < n:
            ways.append(ways[-1] * (n - k) // (k + 1))
            k += 1
        new: dict[int, int] = {}
        for s, c in sums.items():
            for plus, w in enumerate(ways):
                x = s + size * (2 * plus - n)
                new[x] = new.get(x, 0) + c * w
        sums = new
    return sum(c for s, c in sums.items() if s >= least)


def decimal_text(n: int) -> str:
    """The decimal digits of a number of any length; str() refuses more than 4,300."""
    if n < 0:
        return "-" + decimal_text(-n)
    if n < 10**4000:
        return str(n)
    half = n.bit_length() * 3 // 20  # about half of its digits
    high, low = divmod(n, 10**half)
    return decimal_text(high) + decimal_text(low).zfill(half)


def exhaustive_sign_flip(units: DataFrame, item: str, unit: str) -> DataFrame:
    """(extreme, flips): how many of all sign patterns reach the observed total.

    Items are counted by their difference, so what meets on the driver is one row a
    different value.  If the different sizes add up to no more than there are items,
    patterns are counted by a recurrence over the possible sums that holds a few of them,
    otherwise by a histogram of sums.  Sums are bounded by MOST_SUMS, beyond which the
    exact test is refused (use draws).  Counts are whole numbers of any length, returned
    as decimal text if they pass 63 bits.
    """
    rows = units.groupBy(F.col(unit).cast("long").alias("u")).agg(F.count("*").alias("n")).limit(MOST_SUMS + 1).collect()
    sizes: dict[int, int] = {}
    for u, n in rows:
        sizes[abs(u)] = sizes.get(abs(u), 0) + n
    reach, seen = sum(s * n for s, n in sizes.items()), sum(u * n for u, n in rows)
    if len(rows) > MOST_SUMS or 2 * reach + 1 > MOST_SUMS:
        raise ValueError(f"sums up to {reach} are more than the exact test holds: draw sign flips instead")
    none, sizes = sizes.get(0, 0), {s: n for s, n in sorted(sizes.items()) if s}
    every, top = 1 << sum(sizes.values()), (reach - seen) // 2
    if sum(sizes) > sum(sizes.values()):
        extreme = _folded(sizes, seen)
    else:  # turned signs turn a sum of pluses into the rest of the reach, so the shorter side is counted
        extreme = _fewest(sizes, top) if 2 * top <= reach else every - _fewest(sizes, reach - top - 1)
    extreme, flips = extreme << none, every << none
    kind = "long" if flips < 2**63 else "string"
    return units.sparkSession.createDataFrame([(extreme, flips) if kind == "long" else (decimal_text(extreme), decimal_text(flips))], f"extreme {kind}, flips {kind}")


def resampled_totals(units: DataFrame, item: str, unit: str, reps: int, seed: str, draws: str) -> DataFrame:
    """(rep, total) of `reps` resamples of the units in the order of their items.

    draws: "bootstrap" draws as many units with replacement, "signs" gives each a sign.
    The digest sha256 of seed:rep:block gives five draws of 12 hexadecimal digits each,
    modulo the number of units, or 256 signs, bit after bit; so any rep can be drawn
    anywhere.  The units travel to the reps: they
    are one evaluation set, held as one array of at most HELD_UNITS.
    """
    import hashlib

    spark = units.sparkSession
    n = units.count()
    if n > HELD_UNITS:
        raise ValueError(f"{n} units are more than the {HELD_UNITS} that a worker holds")
    values = units.orderBy(item).select(F.col(unit).cast("long")).toPandas().iloc[:, 0].to_numpy(np.int64)  # HELD_UNITS at most
    held = spark.sparkContext.broadcast(values)

    def run(batches):
        own = held.value
        blocks = [f":{k}".encode() for k in range(-(-len(own) // (5 if draws == "bootstrap" else 256)))]
        for pdf in batches:
            totals = []
            for rep in pdf["rep"].tolist():
                start, found = hashlib.sha256(f"{seed}:{rep}".encode()), []
                for block in blocks:
                    h = start.copy()
                    h.update(block)
                    found.append(h.digest())
                drawn = np.frombuffer(b"".join(found), np.uint8)
                if draws == "bootstrap":
                    six = drawn.reshape(-1, 32)[:, :30].reshape(-1, 6)[: len(own)].astype(np.int64)
                    totals.append(int(own[(six << np.arange(40, -1, -8)).sum(axis=1) % len(own)].sum()))
                else:
                    totals.append(int(np.where(np.unpackbits(drawn)[: len(own)] == 1, own, -own).sum()))
            yield pd.DataFrame({"rep": pdf["rep"], "total": totals})

    parts = spark.sparkContext.defaultParallelism * 4
    return spark.range(reps, numPartitions=max(1, min(parts, reps))).select(F.col("id").alias("rep")).mapInPandas(run, "rep long, total long") if n else spark.createDataFrame([], "rep long, total long")


#: Units of a paired comparison that a worker holds.
HELD_UNITS = 2_000_000


def holm(rows: DataFrame, key: str, p: str) -> DataFrame:
    """Step-down adjusted p: the largest, over the hypotheses up to one's own in the order of p and key, of p times those from there on; 1 at most.

    Ranks come from range partitions; the running maximum is that of each partition and
    of those before it, one row a partition.
    """
    ranked = running_totals(rows.select(key, p), [p, key], {}, "holm")
    m = rows.count()
    scaled = ranked.withColumn("vl_scaled", F.least(F.lit(1.0), (F.lit(m) - F.col("position")) * F.col(p))).withColumn("vl_block", F.floor(F.col("position") / HOLM_BLOCK))
    blocks = scaled.groupBy("vl_block").agg(F.max("vl_scaled").alias("vl_most"))  # m / HOLM_BLOCK rows
    before = blocks.select("vl_block", F.expr("max(vl_most) over (order by vl_block rows between unbounded preceding and 1 preceding)").alias("vl_before"))
    within = scaled.withColumn("vl_within", F.expr("max(vl_scaled) over (partition by vl_block order by position rows unbounded preceding)"))
    return within.join(before, "vl_block").select(key, p, F.greatest("vl_within", F.coalesce("vl_before", F.lit(0.0))).alias("adjusted"))


#: Hypotheses of a block of the running maximum.
HOLM_BLOCK = 10_000
