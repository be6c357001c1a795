"""Exact, linearly interpolated quantiles that do not gather the data in one task.

Up to a checked number of values Spark's own exact `percentile` is used.  Beyond
it, global quantiles narrow a bracket around each wanted rank with mergeable
sketches (a few scans, no shuffle of the data), and grouped quantiles count each
(group, value) once and walk those counts in order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfen.operators.keyed import keyed_join
from quillfen.operators.ordered import Ordered
from quillfen.session import EXACT_VALUES, limit_of

_ACCURACY = 10_000
_COLLECTED = 20_000  # values gathered per rank once its bracket is narrow


def quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], limit: int | None = None
) -> dict[str, list[float | None]]:
    """Exact quantiles of whole columns, as driver numbers."""
    limit = limit or limit_of(df.sparkSession, EXACT_VALUES)
    counts = df.agg(*[F.count(c).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    result: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    small = [c for i, c in enumerate(columns) if 0 < counts[i] <= limit]
    if small:
        wanted = F.array(*[F.lit(float(p)) for p in probabilities])
        row = df.agg(*[F.percentile(F.col(c).cast("double"), wanted).alias(c) for c in small]).first()
        result.update({c: list(row[i]) for i, c in enumerate(small)})
    large = {c: counts[i] for i, c in enumerate(columns) if counts[i] > limit}
    if large:
        ranks = {
            (c, k) for c, n in large.items() for p in probabilities
            for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))
        }
        found = _order_statistics(df, large, sorted(ranks), min(limit, _COLLECTED))
        for c, n in large.items():
            for j, p in enumerate(probabilities):
                h = p * (n - 1)
                low, high = found[(c, math.floor(h))], found[(c, math.ceil(h))]
                result[c][j] = low + (high - low) * (h - math.floor(h))
    return result


def _order_statistics(df: DataFrame, sizes: dict, ranks: list, limit: int) -> dict:
    brackets = {key: (None, None, 0, sizes[key[0]]) for key in ranks}
    done: dict = {}

    def inside(column: str, low, high) -> Column:
        value = F.col(column).cast("double")
        if low is None:
            return value
        return F.when(value.between(F.lit(low), F.lit(high)), value)

    while brackets:
        open_keys = [k for k, b in brackets.items() if b[3] > limit]
        if not open_keys:
            break
        # Ranks that still share a bracket share one sketch.
        shared: dict = {}
        for key in open_keys:
            low, high, below, count = brackets[key]
            p, slack = (key[1] - below + 0.5) / count, 2.0 / _ACCURACY
            shared.setdefault((key[0], low, high), {})[key] = (max(0.0, p - slack), min(1.0, p + slack))
        sketch = [
            F.percentile_approx(
                inside(*group), F.array(*[F.lit(p) for pair in wanted.values() for p in pair]), _ACCURACY
            ).alias(f"s{i}")
            for i, (group, wanted) in enumerate(shared.items())
        ]
        found = df.agg(*sketch).first()
        ends = {
            key: (found[i][2 * j], found[i][2 * j + 1])
            for i, wanted in enumerate(shared.values()) for j, key in enumerate(wanted)
        }
        cuts = [ends[key] for key in open_keys]
        checks = []
        for i, key in enumerate(open_keys):
            value = F.col(key[0]).cast("double")
            checks.append(F.count_if(value < cuts[i][0]).alias(f"b{i}"))
            checks.append(F.count_if(value.between(cuts[i][0], cuts[i][1])).alias(f"n{i}"))
        counted = df.agg(*checks).first()
        stuck: dict = {}
        for i, key in enumerate(open_keys):
            low, high, below, count = brackets[key]
            new_low, new_high, new_below, new_count = *cuts[i], counted[f"b{i}"], counted[f"n{i}"]
            if new_below > key[1]:  # the sketch missed upwards: everything below its low end
                new_low, new_high, new_below, new_count = low, new_low, below, new_below - below
                if new_low is None:
                    new_low = float("-inf")
            elif new_below + new_count <= key[1]:
                new_low, new_high = new_high, float("inf") if high is None else high
                new_below, new_count = new_below, below + count - new_below
            if new_low == new_high:
                done[key] = new_low
                del brackets[key]
            elif new_count >= count and low is not None:
                stuck[key] = (new_low, new_high, new_below, new_count)
            else:
                brackets[key] = (new_low, new_high, new_below, new_count)
        _peel(df, stuck, brackets, done)
    if brackets:
        picks = []
        for i, (key, (low, high, below, count)) in enumerate(brackets.items()):
            values = F.sort_array(F.collect_list(inside(key[0], low, high)))  # at most `limit` values
            picks.append(F.element_at(values, key[1] - below + 1).alias(f"v{i}"))
        row = df.agg(*picks).first()
        done.update({key: row[i] for i, key in enumerate(brackets)})
    return done


def _peel(df: DataFrame, stuck: dict, brackets: dict, done: dict) -> None:
    """Settle brackets that the sketch no longer narrows, because heavy values sit at their ends.

    One pass counts both end values and finds their inner neighbours: the rank is at an end, or the bracket loses
    both end values.
    """
    if not stuck:
        return
    picks = []
    for i, (key, (low, high, _, _)) in enumerate(stuck.items()):
        value = F.col(key[0]).cast("double")
        picks += [
            F.count_if(value == F.lit(low)).alias(f"l{i}"),
            F.count_if(value == F.lit(high)).alias(f"h{i}"),
            F.min(F.when((value > F.lit(low)) & (value <= F.lit(high)), value)).alias(f"n{i}"),
            F.max(F.when((value < F.lit(high)) & (value >= F.lit(low)), value)).alias(f"p{i}"),
        ]
    row = df.agg(*picks).first()
    for i, (key, (low, high, below, count)) in enumerate(stuck.items()):
        at_low, at_high = row[f"l{i}"], row[f"h{i}"]
        if key[1] < below + at_low or key[1] >= below + count - at_high:
            done[key] = low if key[1] < below + at_low else high
            del brackets[key]
        else:
            brackets[key] = (row[f"n{i}"], row[f"p{i}"], below + at_low, count - at_low - at_high)


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: dict[str, tuple[str, float]],
    limit: int | None = None,
) -> DataFrame:
    """One row per group with the named (column, probability) quantiles."""
    limit = limit or limit_of(df.sparkSession, EXACT_VALUES)
    needed = list(dict.fromkeys([*keys, *[c for c, _ in columns.values()]]))
    if df.select(*needed).count() <= limit:
        return df.groupBy(*keys).agg(
            *[F.percentile(F.col(c).cast("double"), F.lit(float(p))).alias(n) for n, (c, p) in columns.items()]
        )
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).drop("_rows")
    for column in dict.fromkeys(c for c, _ in columns.values()):
        counted = (
            df.filter(F.col(column).isNotNull())
            .groupBy(*keys, F.col(column).cast("double").alias("_v"))
            .agg(F.count(F.lit(1)).alias("_n"))
        )
        walked = Ordered(counted, ["_v"], keys).running({"_upto": F.col("_n")}).result()
        sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("_size"))
        joined = keyed_join(walked, sizes, keys, "inner")
        picks = []
        for name, (source, p) in columns.items():
            if source != column:
                continue
            h = (F.col("_size") - 1) * F.lit(float(p))
            for end, rank in (("lo", F.floor(h)), ("hi", F.ceil(h))):
                hit = (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
                picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{name}_{end}"))
            picks.append(F.max(h - F.floor(h)).alias(f"_{name}_part"))
        found = joined.groupBy(*keys).agg(*picks)
        values = [
            (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_part")).alias(n)
            for n, (source, _) in columns.items() if source == column
        ]
        out = keyed_join(out, found.select(*keys, *values), keys)
    return out


def cut_codes(column: Column, edges: Sequence[float]) -> Column:
    """Right-closed bin number over ascending edges, lowest edge included; null outside."""
    unique = list(dict.fromkeys(edges))
    if len(unique) < 2:
        return F.lit(None).cast("int")
    code = F.lit(None).cast("int")
    for i in reversed(range(len(unique) - 1)):
        code = F.when(column <= F.lit(unique[i + 1]), F.lit(i)).otherwise(code)
    return F.when(column >= F.lit(unique[0]), code)


def quantile_codes(df: DataFrame, column: str, bins: int) -> Column:
    """Quantile bin number (0-based) on exact edges; duplicate edges are merged."""
    edges = quantiles(df, [column], [i / bins for i in range(bins + 1)])[column]
    return cut_codes(F.col(column).cast("double"), [e for e in edges if e is not None])
