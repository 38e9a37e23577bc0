"""Running values and neighbours over long ordered series.

A window over one key puts all rows of that key into one task, which fails
when a worker or category holds a third of the table. Here every series is cut
into chunks (a time bucket, a page range): the window runs per key *and*
chunk, each chunk is also summed up into one row with map-side combine, and a
second window over those few summary rows carries values across the borders.
Chunks hold equal numbers of rows (``even_chunk``), however the rows crowd in time.
The result equals the plain window, row by row, whatever the size of a key;
NULL keys are a series of their own and a NULL chunk comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _keyed(df: DataFrame, keys: list[str], chunk: str) -> DataFrame:
    """Adds ``_series`` and ``_part``: structs, so that NULLs compare as values."""
    series = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    return df.withColumn("_series", series).withColumn("_part", F.struct(F.col(chunk).alias("c")))


def _inside(order: list[str]):
    return Window.partitionBy("_series", "_part").orderBy(*order)


def _across():
    return Window.partitionBy("_series").orderBy("_part")


def _carry(local: DataFrame, carried: DataFrame) -> DataFrame:
    # same keys as the window before it, so the large side is not shuffled again
    return local.join(carried, ["_series", "_part"], "left")


def running(df: DataFrame, keys: list[str], chunk: str, order: list[str], *,
            sums: dict[str, Column] | None = None,
            maxes: dict[str, Column] | None = None, before: bool = False) -> DataFrame:
    """Adds running sums and maxima per ``keys`` in ``order``.

    ``chunk`` names a column that never decreases along ``order``, where NULL
    is the least value. ``before`` leaves the current row out of the frame.
    Sums start at 0, maxima at NULL.
    """
    sums, maxes = sums or {}, maxes or {}
    steps = {**sums, **maxes}
    folds = {name: (F.sum if name in sums else F.max) for name in steps}

    out = _keyed(df, keys, chunk)
    for name, value in steps.items():
        out = out.withColumn(f"_v_{name}", value)
    totals = out.groupBy("_series", "_part").agg(*[folds[n](f"_v_{n}").alias(f"_t_{n}") for n in steps])
    inside = _inside(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    for n in steps:
        out = out.withColumn(f"_l_{n}", folds[n](f"_v_{n}").over(inside))
    earlier = _across().rowsBetween(Window.unboundedPreceding, -1)
    out = _carry(out, totals.select("_series", "_part", *[
        folds[n](f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in steps]))
    for n in sums:
        zero = F.lit(0)
        out = out.withColumn(n, F.coalesce(f"_c_{n}", zero) + F.coalesce(f"_l_{n}", zero))
    for n in maxes:
        out = out.withColumn(n, F.greatest(f"_c_{n}", f"_l_{n}"))
    return out.select(*df.columns, *steps)


def neighbours(df: DataFrame, keys: list[str], chunk: str, order: list[str], *,
               previous: dict[str, str] | None = None,
               following: dict[str, str] | None = None) -> DataFrame:
    """Adds values of the row before / after per ``keys`` in ``order``.

    ``previous`` and ``following`` map new column names to source columns.
    """
    previous, following = previous or {}, following or {}
    names = (*previous, *following)
    local, inside = _keyed(df, keys, chunk), _inside(order)

    def value(c: str) -> Column:  # a struct, so that a NULL value is a neighbour too
        return F.struct(F.col(c).alias("v"))

    def looked(out: DataFrame, window, suffix: str) -> DataFrame:
        for n, c in previous.items():
            out = out.withColumn(f"{suffix}{n}", F.lag(value(c)).over(window))
        for n, c in following.items():
            out = out.withColumn(f"{suffix}{n}", F.lead(value(c)).over(window))
        return out

    out = looked(local, inside, "_l_")
    first, last = F.lag(F.lit(1)).over(inside).isNull(), F.lead(F.lit(1)).over(inside).isNull()
    out = out.withColumn("_border", first | last)
    # The rows at the borders of chunks, two per key and chunk, stand next to each other there.
    borders = looked(out.where("_border"), Window.partitionBy("_series").orderBy("_part", *order), "_c_")
    settled = [*df.columns, *(F.coalesce(f"_l_{n}", f"_c_{n}")["v"].alias(n) for n in names)]
    inner = [*df.columns, *(F.col(f"_l_{n}")["v"].alias(n) for n in names)]
    return out.where("NOT _border").select(*inner).union(borders.select(*settled))


def since_last(df: DataFrame, keys: list[str], chunk: str, order: list[str], *,
               reset: Column, name: str) -> DataFrame:
    """Adds the number of rows since the last ``reset`` row (0 on that row).

    Before the first reset it counts from the start of the series. The chunk
    summaries come from the windowed rows, so both branches share one shuffle.
    """
    inside = _inside(order)
    local = _keyed(df, keys, chunk).withColumn("_rn", F.row_number().over(inside))
    local = local.withColumn("_reset", F.max(F.when(reset, F.col("_rn"))).over(
        inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = local.groupBy("_series", "_part").agg(F.max("_rn").alias("_rows"), F.max("_reset").alias("_last"))
    earlier = _across().rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    carried = carried.withColumn("_last_before", F.max(F.col("_before") + F.col("_last")).over(earlier))
    out = _carry(local, carried.select("_series", "_part", "_before", "_last_before"))
    last = F.coalesce(F.col("_before") + F.col("_reset"), F.col("_last_before"), F.lit(0))
    return out.withColumn(name, F.col("_before") + F.col("_rn") - last).select(*df.columns, name)


def even_chunk(df: DataFrame, order: list[str], name: str = "_chunk", *, parts: int | None = None) -> DataFrame:
    """Adds a chunk number that grows along ``order`` and gives every chunk about the same number of rows.

    ``order`` is one or two columns of numbers, dates or times. The cuts are quantiles of the first one, taken
    in one pass; a value that fills chunks of its own (a burst in one instant) is cut again by quantiles of the
    second one. ``parts`` cuts, at most, reach the driver.
    """
    parts = parts or max(8, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first, rest = _number(df, order[0]), order[1:]
    shares = [n / parts for n in range(1, parts)]
    cuts = df.agg(F.percentile_approx(first, shares, 16 * parts)).head()[0] or []
    chunk = at_most(first, sorted(set(cuts)))
    crowded = sorted({c for c in cuts if cuts.count(c) > 1})
    if not crowded or not rest:
        return df.withColumn(name, F.struct(chunk.alias("a"), F.lit(0).alias("b")))
    second = _number(df, rest[0])
    inner = {r[0]: sorted(set(r[1])) for r in df.where(first.isin(crowded)).groupBy(first).agg(
        F.percentile_approx(second, [n / 16 for n in range(1, 16)], 256)).collect() if r[1]}
    # Chunks begin at a cut: rows at it come first, cut by the second column, then the rows behind it.
    within = F.lit(0)
    for value in crowded:
        here = at_most(second, inner.get(value, []))
        within = F.when(first == value, here).when(chunk == _place(sorted(set(cuts)), value), F.lit(1 << 20)).otherwise(within)
    return df.withColumn(name, F.struct(chunk.alias("a"), within.alias("b")))


def _number(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.typeName()
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.unix_date(column).cast("bigint") if kind == "date" else F.col(column)


def _place(cuts: list, value) -> int:
    return sum(c <= value for c in cuts)


def at_most(value: Column, cuts: list) -> Column:
    """How many of the sorted cuts are not above a value, by binary search; 0 for NULL."""
    if len(cuts) <= 64:  # small enough to be compiled
        def among(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(value >= F.lit(cuts[middle]), among(middle + 1, high)).otherwise(among(low, middle))
        return among(0, len(cuts))
    edges = F.array(*map(F.lit, cuts))
    steps = F.array(*(F.lit(1 << n) for n in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, width: F.when(
        (at + width <= len(cuts)) & (F.get(edges, at + width - 1) <= value), at + width).otherwise(at))


def time_chunk(ts: str | Column, unit: str = "hour") -> Column:
    """Chunk column for a time-ordered series."""
    return F.date_trunc(unit, ts)


def range_chunk(position: str | Column, size: int = 65536) -> Column:
    """Chunk column for a series numbered by ``position``."""
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / F.lit(size)).cast("bigint")
