"""Ordered-window operators that survive hot keys.

A plain window sends all rows of one key to one task. Here the key counts are looked at
first (one pre-aggregated pass). Keys above a row limit are cut into segments at splitters
drawn from their rows, the window runs per (key, segment), and the few values that have to cross a
segment edge are computed on the segment summaries and joined back. A splitter is a whole
order tuple, so a run of equal first columns is cut like any other. The number of splitters
is bounded by construction, so the split table is safe to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

SEGMENT_ROWS = 1_000_000
MAX_CUTS = 10_000
STRIDE = 64
SAMPLES = 32  # drawn for each segment
SEG = "__segment"


def _segment(heads: Column, cuts: Column, here: Column) -> Column:
    """How many cuts lie below the order tuple; every 64th is in ``heads``, so two short stretches are read."""
    below = lambda a: F.size(F.filter(a, lambda c: c < here))
    block = F.transform(F.array(below(heads)), lambda k: F.when(k == 0, F.lit(0)).otherwise(
        (k - 1) * STRIDE + below(F.slice(cuts, (k - 1) * STRIDE + 1, F.lit(STRIDE)))))
    return F.get(block, F.lit(0))


@dataclass
class Ordered:
    """Rows of ``df`` in the order ``order`` inside each ``keys`` group.

    ``order`` must be a total order; its columns may have any type that can be compared.
    ``most`` is a number of rows that no key exceeds, where the caller knows one; up to a
    segment it spares the count pass.
    """

    df: DataFrame
    keys: list[str]
    order: list[str]
    segment_rows: int = SEGMENT_ROWS
    most: int | None = None
    split: bool = field(init=False, default=False)

    def __post_init__(self) -> None:
        self.keys, self.order = list(self.keys), list(self.order)
        self._cut()

    def _cut(self) -> None:
        if self.most is not None and self.most <= self.segment_rows:
            self.df = self.df.withColumn(SEG, F.lit(0))
            return
        counts = self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("__n"))
        total, largest = counts.agg(F.sum("__n"), F.max("__n")).first()
        limit = max(self.segment_rows, (total or 0) // MAX_CUTS)
        if not largest or largest <= limit:
            self.df = self.df.withColumn(SEG, F.lit(0))
            return
        self.split = True
        hot = counts.filter(F.col("__n") > limit)
        rows = self.df.join(F.broadcast(hot), self.keys) if self.keys else attach_row(self.df, hot)
        # rows are drawn by a hash of their place, so every reader of the plan sees the same splitters
        place = [*self.keys, *self.order]
        drawn = F.pmod(F.xxhash64(*place), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, SAMPLES / limit)))
        order = F.struct(*[F.col(c) for c in self.order])
        sample = rows.filter(drawn).groupBy(*self.keys).agg(F.array_sort(F.collect_list(order)).alias("__s"))
        # at most MAX_CUTS * SAMPLES tuples in all: one splitter per SAMPLES of them
        cuts = F.filter("__s", lambda x, i: i % SAMPLES == SAMPLES - 1)
        found = sample.select(*self.keys, cuts.alias("__cuts")).withColumn("__heads", F.filter("__cuts", lambda x, i: i % STRIDE == 0))
        found = found.select(*self.keys, "__heads", "__cuts")
        local = self.df.sparkSession.createDataFrame(found.toLocalIterator(), found.schema)
        joined = self.df.join(F.broadcast(local), self.keys, "left") if self.keys else attach_row(self.df, local)
        self.df = joined.withColumn(SEG, F.coalesce(_segment(F.col("__heads"), F.col("__cuts"), order), F.lit(0))).drop("__heads", "__cuts")

    # -- building blocks -------------------------------------------------------------

    def _window(self):
        return Window.partitionBy(*self.keys, SEG).orderBy(*self.order)

    def _edges(self, aggregate: Column, name: str) -> DataFrame:
        return self.df.groupBy(*self.keys, SEG).agg(aggregate.alias(name))

    def _join_edges(self, df: DataFrame, edges: DataFrame) -> DataFrame:
        # one row per (key, segment): shuffled like the rows, or broadcast by AQE when small
        return df.join(edges, [*self.keys, SEG], "left")

    def _with(self, df: DataFrame) -> "Ordered":
        copy = object.__new__(Ordered)
        copy.df, copy.keys, copy.order = df, self.keys, self.order
        copy.segment_rows, copy.most, copy.split = self.segment_rows, self.most, self.split
        return copy

    # -- operators -------------------------------------------------------------------

    def neighbour(self, columns: Sequence[str], name: str, step: int = -1) -> "Ordered":
        """Add ``name`` = struct of ``columns`` of the previous (or, step=1, next) row."""
        payload = F.struct(*[F.col(c) for c in columns])
        function = F.lag if step < 0 else F.lead
        out = self.df.withColumn(name, function(payload, 1).over(self._window()))
        if self.split:
            order = F.struct(*[F.col(c) for c in self.order])
            pick = F.max_by(payload, order) if step < 0 else F.min_by(payload, order)
            edges = self._edges(pick, "__edge")
            across = Window.partitionBy(*self.keys).orderBy(SEG)
            edges = edges.withColumn("__edge", function("__edge", 1).over(across))
            out = self._join_edges(out, edges).withColumn(
                name, F.coalesce(F.col(name), F.col("__edge"))
            ).drop("__edge")
        return self._with(out)

    def carried(self, value: Column, name: str, step: int = -1) -> "Ordered":
        """Add the last non-null ``value`` at or before the row (step=1: first at or after)."""
        # a frame to the unbounded end is quadratic, so "next" is "last" in descending order
        order = self.order if step < 0 else [F.desc(c) for c in self.order]
        frame = Window.partitionBy(*self.keys, SEG).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = self.df.withColumn(name, F.last(value, ignorenulls=True).over(frame))
        if self.split:
            order = F.struct(*[F.col(c) for c in self.order])
            tagged = F.when(value.isNotNull(), order)
            pick = F.max_by(value, tagged) if step < 0 else F.min_by(value, tagged)
            edges = self._edges(pick, "__edge")
            across = Window.partitionBy(*self.keys).orderBy(SEG if step < 0 else F.desc(SEG))
            across = across.rowsBetween(Window.unboundedPreceding, -1)
            edges = edges.withColumn("__edge", F.last("__edge", ignorenulls=True).over(across))
            out = self._join_edges(out, edges).withColumn(
                name, F.coalesce(F.col(name), F.col("__edge"))
            ).drop("__edge")
        return self._with(out)

    def running(self, sums: dict[str, Column]) -> "Ordered":
        """Add inclusive running sums, one per entry of ``sums``."""
        frame = self._window().rowsBetween(Window.unboundedPreceding, 0)
        out = self.df.select(
            "*", *[F.sum(c).over(frame).alias(n) for n, c in sums.items()]
        )
        if self.split:
            edges = self.df.groupBy(*self.keys, SEG).agg(
                *[F.sum(c).alias(f"__{n}") for n, c in sums.items()]
            )
            across = (
                Window.partitionBy(*self.keys).orderBy(SEG)
                .rowsBetween(Window.unboundedPreceding, -1)
            )
            edges = edges.select(
                *self.keys, SEG,
                *[F.coalesce(F.sum(f"__{n}").over(across), F.lit(0)).alias(f"__{n}") for n in sums],
            )
            out = self._join_edges(out, edges)
            for n in sums:
                out = out.withColumn(n, F.col(n) + F.col(f"__{n}")).drop(f"__{n}")
        return self._with(out)

    def numbered(self, name: str) -> "Ordered":
        """Add a 1-based row number."""
        return self.running({name: F.lit(1).cast("bigint")})

    def done(self) -> DataFrame:
        return self.df.drop(SEG)


def attach_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row table as a scalar subquery; more than one row is an error."""
    return (
        df.withColumn("__one", one.select(F.struct("*")).scalar()).select("*", "__one.*").drop("__one")
    )


def join_on(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equi-join on the keys, or, without keys, ``b``'s single row added to ``a``."""
    return a.join(b, list(keys)) if keys else attach_row(a, b)


def with_group_size(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Add the row count of the key as a pre-aggregated join instead of a window."""
    if not keys:
        sizes = df.agg(F.count(F.lit(1)).alias(name))
        return attach_row(df, sizes)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return df.join(sizes, list(keys))


ACCURACY = 10_000  # of the sketch that brackets a quantile
MARGIN = 8 / ACCURACY  # of rank on both sides, well beyond the sketch's error


def quantile_bracket(df: DataFrame, keys: Sequence[str], value: str, q: float) -> DataFrame:
    """(keys, __low, __high): values between which the quantile lies, with about two thousandths of the rows of a large key.

    Below four ranks of margin the bracket is the whole key, at most 5,000 rows.
    """
    ranks = F.array(F.lit(max(0.0, q - MARGIN)), F.lit(min(1.0, q + MARGIN)))
    found = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.percentile_approx(F.col(value), ranks, ACCURACY).alias("__b"), F.count(F.lit(1)).alias("__n"), F.min(value).alias("__min"), F.max(value).alias("__max"))
    large = F.col("__n") * MARGIN >= 4
    return found.select(*keys, F.when(large, F.col("__b")[0]).otherwise(F.col("__min")).alias("__low"), F.when(large, F.col("__b")[1]).otherwise(F.col("__max")).alias("__high"))


def exact_quantile(
    df: DataFrame, keys: Sequence[str], value: str, q: float, name: str
) -> DataFrame:
    """Linear-interpolation quantile per key, in two passes.

    The first brackets it by a sketch. The second counts the rows below the bracket and adds up
    the distinct values inside, the only ones that are shuffled and ordered. Hot keys and long
    runs of one value need no more, because counts are pre-aggregated.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    bracketed = join_on(rows, quantile_bracket(df, keys, value, q), keys)
    inside = (F.col("__v") >= F.col("__low")) & (F.col("__v") <= F.col("__high"))
    cells = bracketed.groupBy(*keys, F.when(inside, F.col("__v")).alias("__v")).agg(
        F.count(F.lit(1)).alias("__c"), F.sum((F.col("__v") < F.col("__low")).cast("bigint")).alias("__below"))
    totals = cells.groupBy(*keys).agg(F.sum("__c").alias("__n"), F.sum("__below").alias("__below"))
    ranked = Ordered(cells.filter("__v IS NOT NULL").drop("__below"), keys, ["__v"]).running({"__upto": F.col("__c")}).done()
    both = join_on(ranked, totals, keys)
    upto = F.col("__upto") + F.col("__below")
    at = F.lit(q) * (F.col("__n") - 1)

    def at_rank(rank: Column) -> Column:
        here = (upto > rank) & (upto - F.col("__c") <= rank)
        return F.max(F.when(here, F.col("__v").cast("double")))

    low, high = F.floor(at), F.ceil(at)
    found = both.groupBy(*keys).agg(at_rank(low).alias("__lo"), at_rank(high).alias("__hi"), F.max(at - low).alias("__f"))
    missed = F.raise_error(F.lit("the bracket of a quantile missed it"))
    value_at = F.when(F.col("__lo").isNull() | F.col("__hi").isNull(), missed.cast("double")).otherwise(F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__f"))
    return found.select(*keys, value_at.alias(name))


def centred_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, half: int, name: str) -> DataFrame:
    """Mean over ``half`` rows on both sides of every row.

    A row frame cannot cross a segment edge, so the mean comes from running sums: the sum up
    to row i + half minus the sum up to row i - half - 1, looked up by row number.
    """
    keys = list(keys)
    line = Ordered(df, keys, list(order)).running(
        {"__rn": F.lit(1).cast("bigint"), "__upto": F.lit(0.0) + F.col(value)})
    if not line.split:
        frame = line._window().rowsBetween(-half, half)
        return line.df.withColumn(name, F.avg(value).over(frame)).drop("__rn", "__upto", SEG)
    rows = line.done()
    spread = rows.select(*keys, F.col(value).alias("__v"), F.explode(
        F.sequence(F.col("__rn") - half, F.col("__rn") + half)).alias("__rn"))
    means = spread.groupBy(*keys, "__rn").agg(F.avg("__v").alias(name))
    return rows.join(means, [*keys, "__rn"]).drop("__rn", "__upto")
