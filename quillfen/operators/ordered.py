"""Row-order operators that never bring all rows, or one hot group, into a single task.

Small inputs (checked by a count) use a native window.  Larger ones are range
partitioned on (group keys, order columns), so a group that is too big simply
spans several buckets; prefix results carry the totals of earlier buckets and
bounded frames read copies of neighbouring edge rows.  Only groups that cross a
bucket boundary need a carry, and a boundary is crossed by at most one group, so
the carry tables hold at most two rows per bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfen.operators.keyed import keyed_join
from quillfen.session import ROWS_PER_TASK, cut_lineage, limit_of

BUCKET, INDEX, HALO, TIE = "_bucket", "_row_index", "_halo", "_tie"


class Ordered:
    """A DataFrame seen in the order of `order_by`, separately for each `partition_by` group."""

    def __init__(
        self,
        df: DataFrame,
        order_by: Sequence[str],
        partition_by: Sequence[str] = (),
        rows_per_task: int | None = None,
    ) -> None:
        self.order, self.keys = list(order_by), list(partition_by)
        limit = rows_per_task or limit_of(df.sparkSession, ROWS_PER_TASK)
        rows = df.select(*dict.fromkeys(self.keys + self.order)).count()
        self.buckets = max(1, -(-rows // limit))
        if self.buckets == 1:
            self.df = df.withColumn(BUCKET, F.lit(0))
        else:
            # The checkpoint pins the bucket ids: range bounds are sampled anew on every run.
            self.df = cut_lineage(
                df.withColumn(TIE, F.monotonically_increasing_id())
                .repartitionByRange(self.buckets, *self.keys, *self.order, TIE)
                .withColumn(BUCKET, F.spark_partition_id())
            )
            self.order = self.order + [TIE]

    def _with(self, df: DataFrame) -> Ordered:
        copy = object.__new__(Ordered)
        copy.__dict__.update(self.__dict__)
        copy.df = df
        return copy

    def _window(self) -> WindowSpec:
        return Window.partitionBy(BUCKET, *self.keys).orderBy(*self.order)

    def _groups(self, aggregates: dict[str, Column]) -> DataFrame:
        """Totals per (bucket, group) for the groups that span more than one bucket."""
        totals = self.df.groupBy(BUCKET, *self.keys).agg(*[c.alias(n) for n, c in aggregates.items()])
        if not self.keys:
            return totals
        spans = F.count(F.lit(1)).over(Window.partitionBy(*self.keys))
        return totals.withColumn("_spans", spans).filter("_spans > 1").drop("_spans")

    def _attach(self, df: DataFrame, carry: DataFrame, names: Sequence[str]) -> DataFrame:
        keys = [BUCKET, *self.keys]
        return keyed_join(df, carry.select(*keys, *names), keys, small=True)

    # ---- prefix operators -------------------------------------------------

    def running(self, sums: dict[str, Column]) -> Ordered:
        """Running totals up to and including the current row."""
        frame = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = self.df.select("*", *[F.sum(c).over(frame).alias(n) for n, c in sums.items()])
        if self.buckets > 1:
            before = (
                Window.partitionBy(*self.keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
            )
            names = [f"_c_{n}" for n in sums]
            totals = self._groups({f"_c_{n}": F.sum(c) for n, c in sums.items()})
            carry = totals.select(BUCKET, *self.keys, *[F.sum(n).over(before).alias(n) for n in names])
            out = self._attach(out, carry, names)
            for n in sums:
                total = F.when(
                    F.col(n).isNotNull() | F.col(f"_c_{n}").isNotNull(),
                    F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)),
                )
                out = out.withColumn(n, total)
            out = out.drop(*names)
        return self._with(out)

    def row_index(self, name: str = INDEX) -> Ordered:
        """1-based position of each row."""
        return self.running({name: F.lit(1).cast("long")})

    def _valid(self, columns: dict[str, Column], forward: bool) -> Ordered:
        # Backward fills walk the reversed order: a frame that grows is linear, one that shrinks is not.
        turn = F.asc if forward else F.desc
        grow = (Window.unboundedPreceding, Window.currentRow)
        spec = Window.partitionBy(BUCKET, *self.keys).orderBy(*[turn(c) for c in self.order])
        known = {n: F.last(c, ignorenulls=True).over(spec.rowsBetween(*grow)) for n, c in columns.items()}
        out = self.df.select("*", *[c.alias(n) for n, c in known.items()])
        if self.buckets > 1:
            by_order, choose = F.struct(*self.order), F.max_by if forward else F.min_by
            totals = self._groups(
                {f"_c_{n}": choose(c, F.when(c.isNotNull(), by_order)) for n, c in columns.items()}
            )
            others = Window.partitionBy(*self.keys).orderBy(turn(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
            names = [f"_c_{n}" for n in columns]
            carry = totals.select(
                BUCKET, *self.keys, *[F.last(n, ignorenulls=True).over(others).alias(n) for n in names]
            )
            out = self._attach(out, carry, names)
            for n in columns:
                out = out.withColumn(n, F.coalesce(F.col(n), F.col(f"_c_{n}")))
            out = out.drop(*names)
        return self._with(out)

    def last_valid(self, columns: dict[str, Column]) -> Ordered:
        """Most recent non-null value, current row included."""
        return self._valid(columns, True)

    def next_valid(self, columns: dict[str, Column]) -> Ordered:
        """Nearest non-null value at or after the current row."""
        return self._valid(columns, False)

    # ---- bounded frames ---------------------------------------------------

    def windowed(
        self,
        columns: dict[str, Callable[[WindowSpec], Column]],
        preceding: int = 0,
        following: int = 0,
    ) -> Ordered:
        """Window expressions that look at most `preceding` / `following` rows away."""
        if self.buckets == 1:
            spec = self._window()
            return self._with(self.df.select("*", *[f(spec).alias(n) for n, f in columns.items()]))
        base = self.row_index(INDEX)
        edges = (
            base._groups({"_first": F.min(INDEX), "_last": F.max(INDEX)})
            .select(BUCKET, *self.keys, "_first", "_last")
        )
        reach = self._reach(edges, preceding, following)
        rows = base.df.withColumn(HALO, F.lit(False))
        marked = base._attach(base.df, edges, ["_first", "_last"]).filter(
            (F.col(INDEX) > F.col("_last") - preceding) | (F.col(INDEX) < F.col("_first") + following)
        )
        steps = [d for d in range(-reach, reach + 1) if d]
        copies = (
            marked.drop("_first", "_last")
            .withColumn("_step", F.explode(F.array(*[F.lit(d) for d in steps])))
            .withColumn(BUCKET, F.col(BUCKET) + F.col("_step"))
        )
        copies = base._attach(copies, edges, ["_first", "_last"]).filter(
            (F.col(INDEX) >= F.col("_first") - preceding)
            & (F.col(INDEX) <= F.col("_last") + following)
            & ~F.col(INDEX).between(F.col("_first"), F.col("_last"))
        )
        copies = copies.withColumn(HALO, F.lit(True)).select(*rows.columns)
        spec = Window.partitionBy(BUCKET, *self.keys).orderBy(INDEX)
        out = (
            rows.unionByName(copies)
            .select("*", *[f(spec).alias(n) for n, f in columns.items()])
            .filter(~F.col(HALO))
            .drop(HALO, INDEX)
        )
        return self._with(out)

    def _reach(self, edges: DataFrame, preceding: int, following: int) -> int:
        """How many buckets away a frame may reach: 1 unless buckets are shorter than the frame."""
        groups: dict = {}
        for row in edges.collect():  # at most two rows per bucket
            groups.setdefault(tuple(row[k] for k in self.keys), []).append(
                (row[BUCKET], row["_first"], row["_last"])
            )
        reach = 1
        for spans in groups.values():
            spans.sort()
            for i, (bucket, _, last) in enumerate(spans):
                for other, first, _ in spans[i + 1 + reach :]:
                    if first - last > max(preceding, following):
                        break
                    reach = max(reach, other - bucket)
        return reach

    # ---- exponentially weighted -------------------------------------------

    def ewm(self, value: str, name: str, span: float, adjust: bool, what: str = "mean") -> Ordered:
        """Exponentially weighted mean, or bias-corrected standard deviation, of `value`."""
        alpha = 2.0 / (span + 1.0)
        keys, sort = self.keys, self.keys + self.order
        source = self.df

        def blocks(pdf: pd.DataFrame):
            data = pdf[value].to_numpy(dtype="float64", na_value=np.nan)
            if not keys:
                return [((), data)]
            ids = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            names = [tuple(map(str, row)) for row in pdf.iloc[starts][keys].itertuples(index=False)]
            return list(zip(names, np.split(data, starts[1:])))

        carried: dict = {}
        if self.buckets > 1:
            fields = ["first", "x1", "w", "w2", "wx", "wxx", "c"]

            def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
                bucket = int(pdf[BUCKET].iloc[0])
                return pd.DataFrame(
                    [
                        [bucket, "\x1f".join(key), *_ewm_summary(data, alpha, adjust)]
                        for key, data in blocks(pdf.sort_values(sort))
                    ],
                    columns=[BUCKET, "_group", *fields],
                )

            schema = f"{BUCKET} int, _group string, " + ", ".join(f"{f} double" for f in fields)
            cut = self._groups({"_n": F.count(F.lit(1))}).drop("_n")
            spanning = keyed_join(source, cut, [BUCKET, *keys], "left_semi", small=True)
            parts = spanning.select(*dict.fromkeys([BUCKET, *sort, value])).groupBy(BUCKET)
            running: dict = {}
            # At most two rows per bucket come back.
            for row in sorted(parts.applyInPandas(summarise, schema).collect(), key=lambda r: r[BUCKET]):
                carried[(row[BUCKET], row["_group"])] = running.get(row["_group"])
                running[row["_group"]] = _ewm_advance(running.get(row["_group"]), row, alpha, adjust)

        def apply(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(sort)
            bucket = int(pdf[BUCKET].iloc[0])
            pdf[name] = np.concatenate(
                [
                    _ewm_scan(data, alpha, adjust, carried.get((bucket, "\x1f".join(key))), what)[0]
                    for key, data in blocks(pdf)
                ]
            )
            return pdf

        schema = T.StructType([*source.schema.fields, T.StructField(name, T.DoubleType())])
        grouped = source.groupBy(BUCKET).applyInPandas(apply, schema)
        return self._with(grouped.withColumn(name, F.nanvl(F.col(name), F.lit(None))))

    def result(self) -> DataFrame:
        return self.df.drop(BUCKET, TIE, INDEX)


def _decayed_sums(values: np.ndarray, keep: float) -> np.ndarray:
    """Running sums that lose the factor (1 - keep) per row, by doubling the covered span."""
    sums, step = values.copy(), 1
    while step < len(sums) and keep**step > 1e-20:
        sums[step:] = sums[step:] + keep**step * sums[:-step]
        step *= 2
    return sums


def _ewm_scan(data: np.ndarray, alpha: float, adjust: bool, state, what: str = "mean"):
    """Decaying weighted sums along one ordered block; `c` is the factor left on the start state."""
    keep = 1.0 - alpha
    w, w2, wx, wxx = state if state is not None else (0.0, 0.0, 0.0, 0.0)
    valid = data == data
    if not adjust and not (valid.all() and w in (0.0, 1.0)):
        return _ewm_loop(data, alpha, (w, w2, wx, wxx), what)
    new = np.where(valid, 1.0 if adjust else alpha, 0.0)
    if not adjust and w == 0.0 and len(new):
        new[0] = 1.0  # the first value carries the whole weight
    x = np.where(valid, data, 0.0)
    left = keep ** np.arange(1, len(data) + 1)
    ws = _decayed_sums(new, keep) + w * left
    w2s = _decayed_sums(new * new, keep * keep) + w2 * left * left
    wxs = _decayed_sums(new * x, keep) + wx * left
    wxxs = _decayed_sums(new * x * x, keep) + wxx * left
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = wxs / ws
        spread = np.maximum(0.0, wxxs / ws - mean * mean) * ws * ws / (ws * ws - w2s)
        out = mean if what == "mean" else np.where(ws * ws - w2s > 1e-12 * ws * ws, np.sqrt(spread), np.nan)
    if not len(data):
        return out, (w, w2, wx, wxx), 1.0
    return out, (ws[-1], w2s[-1], wxs[-1], wxxs[-1]), float(left[-1])


def _ewm_loop(data: np.ndarray, alpha: float, state, what: str):
    """The unadjusted form with gaps: weights are renewed at every known value."""
    keep, c = 1.0 - alpha, 1.0
    w, w2, wx, wxx = state
    out = np.full(len(data), np.nan)
    for i, x in enumerate(data):
        w, w2, wx, wxx, c = w * keep, w2 * keep * keep, wx * keep, wxx * keep, c * keep
        if x == x:
            new = 1.0 if w == 0.0 else alpha
            w, w2, wx, wxx = w + new, w2 + new * new, wx + new * x, wxx + new * x * x
            w, w2, wx, wxx, c = 1.0, w2 / (w * w), wx / w, wxx / w, c / w
        if w:
            if what == "mean":
                out[i] = wx / w
            elif w * w - w2 > 1e-12 * w * w:
                out[i] = np.sqrt(max(0.0, wxx / w - (wx / w) ** 2) * w * w / (w * w - w2))
    return out, (w, w2, wx, wxx), c


def _ewm_summary(data: np.ndarray, alpha: float, adjust: bool) -> list:
    """What a block does to an unknown start state."""
    if adjust:
        _, state, c = _ewm_scan(data, alpha, True, None)
        return [np.nan, np.nan, *state, c]
    valid = np.flatnonzero(data == data)
    if len(valid) == 0:
        return [np.nan, np.nan, 0.0, 0.0, 0.0, 0.0, (1 - alpha) ** len(data)]
    first = int(valid[0])
    _, state, c = _ewm_scan(data[first + 1 :], alpha, False, (1.0, 0.0, 0.0, 0.0))
    return [float(first), float(data[first]), *state, c]


def _ewm_advance(state, block, alpha: float, adjust: bool):
    """State after a block, given the state before it."""
    c = block["c"]
    if adjust or block["first"] != block["first"]:
        w, w2, wx, wxx = state or (0.0, 0.0, 0.0, 0.0)
        return (w * c + block["w"], w2 * c * c + block["w2"], wx * c + block["wx"], wxx * c + block["wxx"])
    lead = np.full(int(block["first"]) + 1, np.nan)
    lead[-1] = block["x1"]
    _, (_, w2, wx, wxx), _ = _ewm_scan(lead, alpha, False, state)
    return (block["w"], w2 * c * c + block["w2"], wx * c + block["wx"], wxx * c + block["wxx"])
