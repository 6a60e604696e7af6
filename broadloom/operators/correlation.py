"""Pairwise-complete Pearson correlation over many columns.

Each pair uses the rows where both values are present (missing means NULL or NaN). Two strategies
give the same table:

* ``gram``: every task turns its rows into masked matrix products and emits one packed line per column and tile;
  lines are merged in groups of tasks first, then over all. The data is never shuffled; only task summaries are.
  Tables wider than a tile are worked as pairs of column tiles, each of which reads its own columns only, so the
  memory of a task is bounded by the tile and not by the width.
* ``expressions``: one built-in aggregate per pair. No Python, but the plan grows with the pairs, so it
  is for a handful of them.

A pair with fewer than two rows, or with a constant side on its rows, has a NULL correlation.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from broadloom.operators.selectors import col, quoted_name, quoted_text
from broadloom.session import stage

EXPRESSION_PAIRS = 12
LEAST_TASKS = 4096
PARTITIONS_PER_TASK = 8
CELLS_PER_STEP = 4_000_000
#: Columns of a tile: a task holds a dozen matrices of a tile's square.
TILE_COLUMNS = 1024
#: Tasks whose lines are merged with one another before the exchange over all tasks.
TASKS_PER_GROUP = 64
#: Share of a raw sum of squares below which the centred one is computed again.
CANCELLED = 1e-6

_SUMMARY = "x_ord int, y_ord int, n double, mx double, my double, sxx double, syy double, sxy double"
#: Lines of a column with ``m`` others from ``y_first`` on: six doubles each, one kind after another; null stands for no rows.
_PACKED = "x_ord int, y_first int, m int, task int, data binary"


def correlation_pairs(
    df: DataFrame,
    fields: Sequence[str],
    targets: Sequence[str] | None = None,
    strategy: str = "auto",
    tasks: int | None = None,
    tile: int = TILE_COLUMNS,
) -> DataFrame:
    """``(x, x_ord, y, y_ord, r, n)`` for every pair of fields, the earlier field as ``x``.

    With ``targets`` only field-by-target pairs are computed (``x`` a field, ``y`` a target): the work is
    fields times targets instead of half the square.
    """
    fields = list(fields)
    targets = None if targets is None else list(targets)
    pairs = len(fields) * (len(fields) - 1) // 2 if targets is None else len(fields) * len(targets)
    if strategy == "auto":
        strategy = "expressions" if pairs <= EXPRESSION_PAIRS else "gram"
    if strategy == "expressions":
        sums = _by_expressions(df, fields, targets)
    else:
        sums = _by_gram(df, fields, targets, tasks, tile)
    x_names, y_names = fields, fields if targets is None else targets
    return sums.select(
        _name_at(x_names, "x_ord").alias("x"),
        "x_ord",
        _name_at(y_names, "y_ord").alias("y"),
        "y_ord",
        _r().alias("r"),
        F.col("n").cast("bigint").alias("n"),
    )


def _name_at(names: Sequence[str], ordinal: str) -> Column:
    return F.expr(f"element_at(array({', '.join(quoted_text(n) for n in names)}), {ordinal} + 1)")


def _r() -> Column:
    """From centred sums to r, NULL instead of a division by zero, clamped against rounding."""
    ratio = F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy"))
    finite = (F.col("n") >= 2) & ratio.isNotNull() & ~F.isnan(ratio)  # greatest and least skip NULLs
    return F.when(finite, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))


def _value(name: str) -> Column:
    """A column as double with NaN as missing."""
    return F.nullif(col(name).cast("double"), F.lit(float("nan")))


def _by_expressions(df: DataFrame, fields: list[str], targets: list[str] | None) -> DataFrame:
    left = df.select(*[_value(f).alias(f"x{i}") for i, f in enumerate(fields)])
    if targets is None:
        pairs = [(i, j, f"x{i}", f"x{j}") for i in range(len(fields)) for j in range(i + 1, len(fields))]
    else:
        left = df.select(
            *[_value(f).alias(f"x{i}") for i, f in enumerate(fields)],
            *[_value(t).alias(f"y{j}") for j, t in enumerate(targets)],
        )
        pairs = [(i, j, f"x{i}", f"y{j}") for i in range(len(fields)) for j in range(len(targets))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "x_ord int, y_ord int, n double, sxx double, syy double, sxy double")
    # regr_* skip rows where either side is NULL; the second argument is the regressor
    aggregates = [
        F.struct(
            F.lit(i).alias("x_ord"),
            F.lit(j).alias("y_ord"),
            F.expr(f"CAST(regr_count({y}, {x}) AS DOUBLE)").alias("n"),
            F.expr(f"regr_sxx({y}, {x})").alias("sxx"),
            F.expr(f"regr_syy({y}, {x})").alias("syy"),
            F.expr(f"regr_sxy({y}, {x})").alias("sxy"),
        )
        for i, j, x, y in pairs
    ]
    return left.agg(F.array(*aggregates).alias("p")).select(F.inline("p"))


def _by_gram(df: DataFrame, fields: list[str], targets: list[str] | None, tasks: int | None, tile: int) -> DataFrame:
    wanted = list(dict.fromkeys(fields + (targets or [])))
    at = {n: i for i, n in enumerate(wanted)}
    values = df.selectExpr(*[f"CAST({quoted_name(n)} AS DOUBLE) AS v{i}" for n, i in at.items()])
    xs, ys = [at[f] for f in fields], [at[n] for n in (fields if targets is None else targets)]
    starts = [(a, b) for a in range(0, len(xs), tile) for b in range(0, len(ys), tile) if targets is not None or b >= a]
    if len(starts) > 1:  # every pair of tiles reads its columns: from files, not by running the plan again
        values = stage(values, "wide")
    # beyond LEAST_TASKS partitions, one summary for several of them: lines stay a small share of the data
    parts = values.rdd.getNumPartitions()
    parts = min(parts, tasks or max(min(parts, LEAST_TASKS), parts // PARTITIONS_PER_TASK))
    lines = _no_rows(df, len(xs), len(ys), tile, targets is None)
    for a, b in starts:
        left, right = xs[a : a + tile], ys[b : b + tile]
        chosen = sorted({*left, *right})
        spot = {c: i for i, c in enumerate(chosen)}
        narrow = values.select(*[f"v{c}" for c in chosen]).coalesce(parts)
        diagonal = targets is None and a == b
        lines = lines.union(narrow.mapInArrow(_summariser([spot[c] for c in left], [spot[c] for c in right], a, b, diagonal), _PACKED))
    if parts > TASKS_PER_GROUP:
        grouped = lines.withColumn("task", F.expr(f"task div {TASKS_PER_GROUP}"))
        lines = _in_line(grouped, "x_ord", "y_first", "task").mapInArrow(_merger(unpack=False), _PACKED)
    return _in_line(lines, "x_ord", "y_first").mapInArrow(_merger(unpack=True), _SUMMARY)


def _in_line(lines: DataFrame, *keys: str) -> DataFrame:
    """Lines of equal keys one after another, in the order of their tasks."""
    return lines.repartition(*keys).sortWithinPartitions("x_ord", "y_first", "task", "data")


def _no_rows(df: DataFrame, width: int, others: int, tile: int, square: bool) -> DataFrame:
    """A line without rows for every column and tile, so that pairs which never share a row are listed too."""
    own = f"CAST(id div {tile} * {tile} AS INT)" if square else "0"
    starts = F.explode(F.expr(f"sequence({own}, {max(others - 1, 0)}, {tile})")).alias("start")
    tiles = df.sparkSession.range(0, width if others else 0, 1, 1).select(F.col("id").cast("int").alias("x_ord"), starts)
    first = F.greatest(F.col("x_ord") + 1, F.col("start")) if square else F.col("start")
    count = F.least(F.col("start") + tile, F.lit(others)) - F.col("y_first")
    rows = tiles.select("x_ord", "start", first.cast("int").alias("y_first")).select("x_ord", "y_first", count.cast("int").alias("m"))
    return rows.where("m > 0").select("x_ord", "y_first", "m", F.lit(-1).alias("task"), F.lit(None).cast("binary").alias("data"))


def _summariser(left: list[int], right: list[int], x_start: int, y_start: int, square: bool):
    """The per-task part of the Gram strategy: Arrow batches in, a packed line per left column out.

    Batches are taken in slices to bound the memory of a step. In a slice every column is shifted by its
    median; a pair whose sums still cancel is computed again around its own mean. Slices are merged by the
    formula for means and moments, never by raw sums, so neither outliers nor large offsets reach other pairs.
    """
    cells = CELLS_PER_STEP

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        a, b = left, right
        width = len({*left, *right})
        most_rows = max(1, cells // width)
        wanted = np.triu(np.ones((len(a), len(b)), bool), 1) if square else np.ones((len(a), len(b)), bool)

        def moments(data):
            """``n``, both means and the three centred sums of each pair of a slice."""
            present = ~np.isnan(data)
            base = np.zeros(data.shape[1])
            some = present.any(axis=0)
            base[some] = np.nan_to_num(np.nanmedian(data[:, some], axis=0), posinf=0.0, neginf=0.0)
            infinite = np.isinf(data)
            centred = np.where(present & ~infinite, data - base, 0.0)
            mask = present.astype("float64")
            xa, ma, xb, mb = centred[:, a], mask[:, a], centred[:, b], mask[:, b]
            n, sx, sxx, sxy = ma.T @ mb, xa.T @ mb, (xa * xa).T @ mb, xa.T @ xb
            sy, syy = (sx.T, sxx.T) if square else (ma.T @ xb, ma.T @ (xb * xb))
            m = np.maximum(n, 1.0)
            out = [n, base[a][:, None] + sx / m, base[b][None, :] + sy / m, sxx - sx * sx / m, syy - sy * sy / m, sxy - sx * sy / m]
            out[1][n == 0] = out[2][n == 0] = 0.0
            # an infinite value spoils the pairs that have its row, and no others
            spoiled = np.zeros(n.shape, bool)
            if infinite.any():
                spoiled = (infinite[:, a].astype("float64").T @ mb + ma.T @ infinite[:, b].astype("float64")) > 0
                for v in out[1:]:
                    v[spoiled] = np.nan
            cancels = wanted & (n > 0) & ~spoiled & ~((out[3] > CANCELLED * sxx) & (out[4] > CANCELLED * syy))
            for i, j in zip(*np.nonzero(cancels)):
                both = present[:, a[i]] & present[:, b[j]]
                x, y = data[both, a[i]], data[both, b[j]]
                dx, dy = x - x[0], y - y[0]
                mx, my = dx.mean(), dy.mean()
                dx, dy = dx - mx, dy - my
                for k, value in enumerate((x[0] + mx, y[0] + my, dx @ dx, dy @ dy, dx @ dy), 1):
                    out[k][i, j] = value
            return out

        total = None
        with np.errstate(all="ignore"):
            for batch in batches:
                for start in range(0, batch.num_rows, most_rows):
                    piece = batch.slice(start, most_rows)
                    data = np.column_stack([piece.column(i).to_numpy(zero_copy_only=False) for i in range(width)]).astype("float64")
                    new = moments(data)
                    total = new if total is None else _merged(total, new)
        if total is None:
            return
        total[0][~wanted] = 0.0
        task = TaskContext.get().partitionId()
        for i in range(len(a)):
            first = i + 1 if square else 0
            if first < len(b):
                line = np.concatenate([v[i, first:] for v in total]).tobytes()
                columns = [[x_start + i], [y_start + first], [len(b) - first], [task], [line]]
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["x_ord", "y_first", "m", "task", "data"])

    return run


def _merged(one, two):
    """``n``, means and centred sums of two sets of rows together."""
    import numpy as np

    n = one[0] + two[0]
    share = two[0] / np.maximum(n, 1.0)
    dx, dy, f = two[1] - one[1], two[2] - one[2], one[0] * share
    return [
        n, one[1] + dx * share, one[2] + dy * share,
        one[3] + two[3] + dx * dx * f, one[4] + two[4] + dy * dy * f, one[5] + two[5] + dx * dy * f,
    ]


def _merger(unpack: bool):
    """Merge the sorted lines of a partition by column, tile and task group; the state is one line.

    ``unpack`` merges over all tasks and gives a row per pair.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(key, m, held):
            held = np.zeros((6, m)) if held is None else held
            if not unpack:
                columns = [[key[0]], [key[1]], [m], [key[2]], [np.concatenate(held).tobytes()]]
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["x_ord", "y_first", "m", "task", "data"])
            ords = [np.full(m, key[0], np.int32), np.arange(key[1], key[1] + m, dtype=np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (*ords, *held)], ["x_ord", "y_ord", "n", "mx", "my", "sxx", "syy", "sxy"])

        now, width, held = None, 0, None
        with np.errstate(all="ignore"):
            for batch in batches:
                for x, y, m, task, data in zip(*(c.to_pylist() for c in batch.columns)):
                    key = (x, y) if unpack else (x, y, task)
                    if key != now:
                        if now is not None:
                            yield out(now, width, held)
                        now, width, held = key, m, None
                    if data is not None:
                        new = list(np.frombuffer(data).reshape(6, m))
                        held = new if held is None else _merged(held, new)
            if now is not None:
                yield out(now, width, held)

    return run


def both_ways(pairs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The square matrix in long form ``(x, y, r)``: both orientations and a NULL diagonal."""
    turned = F.array(F.struct("x", "y", "r"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "r"))
    diagonal = pairs.sparkSession.createDataFrame([(f, f, None) for f in fields], "x string, y string, r double")
    return pairs.select(F.inline(turned)).union(diagonal)


def known_pairs(pairs: DataFrame) -> DataFrame:
    """Each pair once, pairs without a correlation left out."""
    return pairs.where((F.col("x_ord") < F.col("y_ord")) & F.col("r").isNotNull()).select("x", "y", "r")


def focus(target_pairs: DataFrame, targets: Iterable[str]) -> DataFrame:
    """Field-by-target table: one row per field, one column per target."""
    targets = list(targets)
    return target_pairs.groupBy(F.col("x").alias("term")).agg(
        *[F.max(F.when(F.col("y") == t, F.col("r"))).alias(t) for t in targets]
    )
