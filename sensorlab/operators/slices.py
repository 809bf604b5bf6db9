"""Splitting of long series into slices of bounded size.

Window functions put a whole window partition into one task. A series that
holds a large part of all rows must therefore not be a window partition of its
own. ``plan_slices`` counts the rows per series and, for series above the limit
only, finds cut points by distributed counting: a histogram over the series'
own range, then one within each bin that is still too full, level by level,
first over time and, within one instant, over what orders it. Whatever the
distribution, every (series, slice) pair holds at most the limit, unless rows
cannot be told apart. What an operator needs from earlier or later slices is
added to each slice as a few extra rows before its window runs:

* ``carry_around``: both neighbouring readings of each slice,
* ``number_rows`` / ``row_blocks``: exact row numbers, and blocks of rows with
  a margin of rows on both sides.

Series below the limit keep a single slice. Planning starts one small job on
the columns of the key and the order; the rest runs only for longer series.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorlab.session import SLICE_ROWS, setting, stored

SLICE = "_slice"
HOT = "_hot"
BLOCK = "_block"
MARGIN = "_margin"
MAP = "_cuts"

#: Bins for each expected slice, and the least and most bins of one histogram.
BINS, FEW, MANY = 8, 16, 4096
#: Beyond this, numbers count as equal.
FAR = 1e300


def micros(column: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; needs no job."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return int(str(plan.stats().sizeInBytes()))


def same_key(left: DataFrame, right: DataFrame, key: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in key], F.lit(True))


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of equal names, in which nulls are equal; the left side's ones stay."""
    if not on:
        return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one", how).drop("_one")
    names = {c: f"_other_{c}" for c in on}
    right = right.withColumnsRenamed(names)
    return left.join(right, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(o)) for c, o in names.items()]), how).drop(*names.values())


@dataclass(frozen=True)
class SlicePlan:
    """The series that are split, with the tree of their cut points.

    ``hot`` has a row per split series: its number of slices and an array of
    nodes. A node divides the values of one of the ordering numbers, or their
    binades, into bins of equal width; a child of a bin is a slice's number or,
    negative, another node. Without ``hot`` no series is split.
    """

    key: tuple[str, ...]
    hot: DataFrame | None = field(default=None, compare=False)
    depth: int = 0

    @property
    def single(self) -> bool:
        return self.hot is None

    @property
    def group(self) -> list[str]:
        """Columns to partition windows by."""
        return [*self.key] if self.single else [*self.key, SLICE]

    def _mapped(self, df: DataFrame) -> DataFrame:
        """Add the series' cuts, null where it isn't split; ``hot`` is stored, so Spark knows if it can broadcast it."""
        return null_safe_join(df.drop(HOT), self.hot, self.key, "left")

    def mark_hot(self, df: DataFrame) -> DataFrame:
        if self.single:
            return df.withColumn(HOT, F.lit(False))
        return self._mapped(df).withColumn(HOT, F.col(MAP).isNotNull())

    def assign(self, df: DataFrame, *by: Column, name: str = SLICE) -> DataFrame:
        """Add the slice number of the position ``by`` (0 for series not split)."""
        if self.single:
            return df.withColumn(name, F.lit(0))
        mapped = df if MAP in df.columns else self.mark_hot(df)
        places = [f"_place{i}" for i in range(len(by))]
        mapped = mapped.withColumns({p: finite_number(c) for p, c in zip(places, by, strict=True)})
        return mapped.withColumn(name, self._slice_of(places)).drop(MAP, *places)

    def every_slice(self) -> DataFrame:
        """A row for each slice of the split series."""
        return self.hot.select(*self.key, F.explode(F.sequence(F.lit(0), F.col(f"{MAP}.slices") - 1)).alias(SLICE))

    def _slice_of(self, places: Sequence[str]) -> Column:
        """The slice of a position; numbers and nodes are looked at many times, so each is made just once."""
        numbers = [F.col(p) for p in places]

        def child(node: Column) -> Column:
            # What the plan looks at and the caller hasn't got counts as the least.
            x = F.coalesce(F.get(F.array(*numbers), node["dim"]), F.lit(-FAR))
            # A node for one instant is passed on its left or right by positions at others.
            for i in reversed(range(len(numbers) - 1)):
                here, beyond = F.get(node["anchor"], F.lit(i)), node["dim"] > i
                x = F.when(beyond & (numbers[i] < here), F.lit(-FAR)).when(beyond & (numbers[i] > here), F.lit(FAR)).otherwise(x)
            bin_ = bin_of(x, node["log"], node["low"], node["width"], F.size(node["children"]))
            return F.get(node["children"], bin_)

        def child_of(node: Column) -> Column:
            return F.get(F.transform(F.array(node), child), F.lit(0))

        nodes = F.col(f"{MAP}.nodes")
        found = child_of(F.get(nodes, F.lit(0)))
        if self.depth > 1:
            deeper = F.sequence(F.lit(2), F.lit(self.depth))
            found = F.aggregate(deeper, found, lambda c, _: F.when(c < 0, child_of(F.get(nodes, -c))).otherwise(c))
        return F.coalesce(found, F.lit(0))


def finite_number(column: Column) -> Column:
    """An ordering number as a finite double; nulls sort first, NaN last."""
    x = F.coalesce(F.nanvl(column.cast("double"), F.lit(FAR)), F.lit(-FAR))
    return F.greatest(F.least(x, F.lit(FAR)), F.lit(-FAR))


def _binade(x: Column) -> Column:
    """A number that rises with x, one for each power of two."""
    size = F.floor(F.log2(F.when(x == 0, F.lit(1.0)).otherwise(F.abs(x)))) + 1100
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * size)


def bin_of(x: Column, log: Column, low: Column, width: Column, bins: Column) -> Column:
    place = (F.when(log, _binade(x)).otherwise(x) - low) / width
    return F.floor(F.greatest(F.lit(0.0), F.least(place, bins - F.lit(1.0)))).cast("int")


def histogram_of(low: Column, high: Column, parts: Column) -> list[Column]:
    """``log, low, width, bins`` of a histogram from ``low`` to ``high``, over binades if there are several, else with bins for ``parts`` parts."""
    log = _binade(low) != _binade(high)
    even = F.least(F.greatest(F.ceil(parts) * BINS, F.lit(FEW)), F.lit(MANY))
    bins = F.when(log, _binade(high) - _binade(low) + 1).otherwise(even).cast("int")
    width = F.when(log, F.lit(1.0)).otherwise(F.greatest((high - low) / bins, F.lit(5e-324)))
    return [log.alias("log"), F.when(log, _binade(low)).otherwise(low).alias("low"), width.alias("width"), bins.alias("bins")]


def plan_slices(df: DataFrame, key: Sequence[str], *by: Column) -> SlicePlan:
    """Decide which series of ``df`` must be split and where.

    ``by`` are the numbers that order a series, the first one first. A bin may
    hold a quarter of the limit; fuller ones are divided again, over binades if
    their numbers span several, else over their range. Slices are runs of bins
    with three quarters of the limit, so that none exceeds it.
    """
    limit = setting(df.sparkSession, SLICE_ROWS)
    part = max(1, limit // 4)
    key = tuple(key)
    names = [f"_d{i}" for i in range(len(by))]
    slim = df.select(*key, *[finite_number(c).alias(n) for c, n in zip(by, names, strict=True)])
    stats = [F.count("*").alias("_n")]
    stats += [f(n).alias(f"{n}{end}") for n in names for f, end in ((F.min, "_low"), (F.max, "_high"))]
    varies = [F.col(f"{n}_low") < F.col(f"{n}_high") for n in names]
    divisible = reduce(lambda a, b: a | b, varies)

    def histogram(counts: DataFrame, path: Column) -> DataFrame:
        """The histogram that each row's bin is divided by."""

        def of_dim(pick) -> Column:
            return F.coalesce(*[F.when(v, pick(i)) for i, v in enumerate(varies)])

        low, high = of_dim(lambda i: F.col(f"{names[i]}_low")), of_dim(lambda i: F.col(f"{names[i]}_high"))
        anchor = F.array(*[F.col(f"{n}_low") for n in names])
        spec = [of_dim(F.lit).cast("int").alias("dim"), anchor.alias("anchor"), *histogram_of(low, high, F.col("_n") / limit)]
        return counts.select(*key, path.alias("_path"), F.struct(*spec).alias("_spec"))

    sizes = slim.groupBy(*key).agg(*stats).filter((F.col("_n") > limit) & divisible)
    if sizes.isEmpty():
        return SlicePlan(key)
    level = stored(histogram(sizes, F.array().cast("array<int>")), "series")
    levels, bins = [level], []
    rows = slim.withColumn("_path", F.array().cast("array<int>"))
    spot = [*key, "_path"]
    while True:
        joined = null_safe_join(rows, level, spot)
        x = F.get(F.array(*names), F.col("_spec.dim"))
        bin_ = bin_of(x, *(F.col(f"_spec.{c}") for c in ("log", "low", "width", "bins")))
        binned = joined.withColumn("_bin", bin_)
        bins.append(stored(binned.groupBy(*spot, "_bin").agg(*stats), "bins"))
        below = F.concat("_path", F.array("_bin"))
        full = bins[-1].filter((F.col("_n") > part) & divisible)
        if full.isEmpty():
            break
        level = stored(histogram(full, below), "level")
        levels.append(level)
        rows = binned.select(*key, *names, below.alias("_path"))
    return SlicePlan(key, _cut_points(key, levels, bins, limit - part or 1), len(levels))


def _cut_points(key: tuple[str, ...], levels: list[DataFrame], bins: list[DataFrame], quota: int) -> DataFrame:
    """A row per split series: its histograms as nodes, with the slice or node of every bin."""
    spot = [*key, "_path"]
    nodes = reduce(DataFrame.unionByName, levels)
    nodes = nodes.withColumn("_index", F.row_number().over(Window.partitionBy(*key).orderBy("_path")) - 1)
    counts = reduce(DataFrame.unionByName, [b.select(*spot, "_bin", "_n") for b in bins])
    # A bin that is divided itself holds no rows of its own.
    split = nodes.filter(F.size("_path") > 0).select(
        *key, F.slice("_path", 1, F.size("_path") - 1).alias("_path"), F.element_at("_path", -1).alias("_bin"), F.col("_index").alias("_child")
    )
    every = nodes.select(*spot, F.posexplode(F.array_repeat(F.lit(0), F.col("_spec.bins"))).alias("_bin", "_zero"))
    every = every.select(*spot, "_bin", F.lit(0).cast("long").alias("_n"), F.lit(None).cast("int").alias("_child"))
    known = counts.withColumn("_child", F.lit(None).cast("int"))
    split = split.withColumn("_n", F.lit(0).cast("long"))
    cells = reduce(DataFrame.unionByName, [every, known, split]).groupBy(*spot, "_bin").agg(F.sum("_n").alias("_n"), F.max("_child").alias("_child"))
    own = F.when(F.col("_child").isNull(), F.col("_n")).otherwise(0)
    order = Window.partitionBy(*key).orderBy(F.concat("_path", F.array("_bin"))).rowsBetween(Window.unboundedPreceding, -1)
    number = F.floor(F.coalesce(F.sum(own).over(order), F.lit(0)) / quota).cast("int")
    cells = cells.withColumn("_number", number).withColumn("_value", F.coalesce(-F.col("_child"), F.col("_number")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_bin", "_value"))), lambda c: c["_value"])
    children = cells.groupBy(*spot).agg(listed.alias("children"), F.max("_number").alias("_last"))
    both = null_safe_join(nodes, children, spot)
    entry = F.struct("_path", *[F.col(f"_spec.{c}").alias(c) for c in ("dim", "anchor", "log", "low", "width")], "children")
    series = both.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias("_nodes"), (F.max("_last") + 1).alias("_slices"))
    bare = F.transform("_nodes", lambda n: F.struct(*[n[c].alias(c) for c in ("dim", "anchor", "log", "low", "width", "children")]))
    cuts = F.struct(F.col("_slices").alias("slices"), bare.alias("nodes"))
    return stored(series.select(*key, cuts.alias(MAP)), "cuts")


def carry_around(sliced: DataFrame, plan: SlicePlan, reading: str) -> DataFrame:
    """The neighbours of each (series, slice), as rows: the last reading before
    it, the first one at that reading's time, and the first one behind it.

    One aggregate yields both ends of every slice. ``reading`` is a struct that
    begins with ``us`` and ``seq``.
    """
    early = F.struct(F.col(f"{reading}.us").alias("us"), (-F.col(f"{reading}.seq")).alias("back"), F.col(reading).alias("r"))
    ends = (
        sliced.filter(HOT)
        .groupBy(*plan.group)
        .agg(
            F.min(reading).alias("_low"),
            F.max(reading).alias("_high"),
            F.max(F.when(F.col(reading).isNotNull(), early)).alias("_early"),
        )
    )
    order = Window.partitionBy(*plan.key).orderBy(SLICE)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*plan.key).orderBy(F.col(SLICE).desc())
    found = [F.max("_high").over(earlier), F.max("_early").over(earlier)["r"], F.min("_low").over(back.rowsBetween(Window.unboundedPreceding, -1))]
    both = ends.select(*plan.group, *[f.alias(n) for f, n in zip(found, ("_before", "_same", "_after"), strict=True)])
    rows = both.select(*plan.group, F.explode(F.array("_before", "_same", "_after")).alias(reading))
    return rows.filter(F.col(reading).isNotNull())


def order_number(df: DataFrame, column: str) -> Column:
    """Number that sorts like ``column``."""
    kind = dict(df.dtypes)[column]
    return micros(column) if kind.startswith("timestamp") else F.col(column)


def order_numbers(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """Numbers for the leading columns of an order that are times or numbers."""
    kinds = dict(df.dtypes)
    plain = ("timestamp", "bigint", "int", "double", "float", "smallint", "tinyint", "decimal")
    usable = []
    for column in order[:2]:
        if not kinds[column].startswith(plain):
            break
        usable.append(order_number(df, column))
    return usable or [order_number(df, order[0])]


def number_rows(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    name: str = "_row",
    total: str | None = None,
    plan: SlicePlan | None = None,
) -> DataFrame:
    """Exact 0-based position of each row in its series.

    ``total`` names a column for the size of the series. Split series are
    numbered slice by slice; each slice starts at the size of the earlier ones,
    delivered as an extra row in front of it.
    """
    by = order_numbers(df, order)
    plan = plan or plan_slices(df, key, *by)
    rows = plan.assign(plan.mark_hot(df), *by).withColumn("_weight", F.lit(1).cast("long"))
    rows = rows.withColumn("_front", F.lit(1))
    start = F.lit(0)
    if not plan.single:
        in_series = Window.partitionBy(*plan.key)
        before = in_series.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        fronts = (
            rows.filter(HOT)
            .groupBy(*plan.group)
            .agg(F.sum("_weight").alias("_size"))
            .select(
                *plan.group,
                F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
                F.sum("_size").over(in_series).alias("_all"),
            )
            .withColumns({"_front": F.lit(0), "_weight": F.lit(0).cast("long")})
        )
        rows = rows.unionByName(fronts, allowMissingColumns=True)
    w = Window.partitionBy(*plan.group).orderBy("_front", *order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    if not plan.single:
        start = F.coalesce(F.max("_start").over(so_far), F.lit(0))
    made = {name: F.sum("_weight").over(so_far) - F.col("_weight") + start}
    if total:
        size = F.sum("_weight").over(Window.partitionBy(*plan.group))
        made[total] = size if plan.single else F.coalesce(F.max("_all").over(so_far), size)
    return rows.withColumns(made).filter(F.col("_front") == 1).select(*df.columns, *made)


def row_blocks(
    df: DataFrame, key: Sequence[str], order: Sequence[str], before: int = 0, after: int = 0, plan: SlicePlan | None = None
) -> DataFrame:
    """Blocks in which row frames of ``before`` / ``after`` rows are complete.

    Adds ``_block`` (partition windows by key and it) and ``_margin`` (true on
    the repeated rows at the edges, to be dropped after the windows ran).
    """
    plan = plan or plan_slices(df, key, *order_numbers(df, order))
    if plan.single:
        return df.withColumn(BLOCK, F.lit(0)).withColumn(MARGIN, F.lit(False))
    size = max(setting(df.sparkSession, SLICE_ROWS), before + after)
    numbered = number_rows(df, key, order, plan=plan)
    block = F.floor(F.col("_row") / size).cast("int")
    place = F.col("_row") % size

    def copy(to: Column, margin: bool) -> Column:
        return F.struct(to.cast("int").alias(BLOCK), F.lit(margin).alias(MARGIN))

    copies = F.array_compact(
        F.array(
            copy(block, False),
            F.when(place >= size - before, copy(block + 1, True)),
            F.when((place < after) & (block > 0), copy(block - 1, True)),
        )
    )
    return numbered.withColumn("_copy", F.explode(copies)).select(
        *df.columns, F.col(f"_copy.{BLOCK}"), F.col(f"_copy.{MARGIN}")
    )


def drop_margin(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(MARGIN)).drop(BLOCK, MARGIN)


def tie_order(df: DataFrame, key: Sequence[str], ts: str, seq: str | None) -> list[str]:
    """Total order within a series: time, then arrival, then the other columns."""
    if seq is not None:
        return [ts, seq]
    skip = {*key, ts}
    return [ts] + [c for c, t in df.dtypes if c not in skip and not t.startswith("map")]
