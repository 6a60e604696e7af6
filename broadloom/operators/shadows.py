"""Shadow columns: every field again, its values moved to other rows.

Rows are dealt into blocks by key hash, each block is put in hash order, and a shadow is its column
rotated by an offset drawn per run and field: whole arrays are sliced, no value is looked up singly. Stored blocks hold a
plain array per column, so a run slices numbers and never takes records apart.
Blocks are random sets of rows of bounded size, so a rotation keeps each column's distribution exactly
while breaking its tie to the target and to other columns. The data is exchanged once; further runs
only rotate the stored blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from broadloom.functions import cells
from broadloom.operators.selectors import col, quoted_name

ROWS_PER_BLOCK = 1000
BLOCK = "__block"


def block_count(rows: int, per_block: int = ROWS_PER_BLOCK) -> int:
    return max(1, math.ceil(rows / per_block))


def shadow_blocks(df: DataFrame, key: str, columns: Iterable[str], blocks: int, seed: int) -> DataFrame:
    """One row per block: ``__block`` and an array per column, with the rows in hash order.

    Stage them where several runs read them: what is stored is plain arrays, unstaged each run takes records apart.
    """
    columns = list(dict.fromkeys(columns))
    row = F.struct(cells.hash_hex(f"{seed}.order", col(key)).alias("h"), *[col(n) for n in columns])
    block = (cells.hash_int(seed, col(key)) % blocks).cast("int").alias(BLOCK)
    # exchanging the plain rows first saves the map tasks from building lists they cannot shorten
    dealt = df.select(block, row.alias("row")).repartition(BLOCK)
    grouped = dealt.groupBy(BLOCK).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return grouped.select(BLOCK, *[F.col("rows").getField(n).alias(n) for n in columns])


def offset_draw(seed: int, run: int | str, field: str) -> int:
    """The number an offset is derived from: the first 32 bits of md5 of seed, run and field."""
    return int(hashlib.md5(f"{seed}|{run}|{field}".encode()).hexdigest()[:8], 16)


def shadow_name(field: str, run: int) -> str:
    return f"shadow_{run}_{field}"


def shadow_arrays(
    blocks: DataFrame, keep: Sequence[str], fields: Sequence[str], runs: Iterable[int], seed: int, position: str | None = None
) -> DataFrame:
    """One row per block with an array per column: the ``keep`` columns and, for each run and field, a rotated copy;
    with ``position`` also the places of the rows in their block."""
    runs = list(runs)
    q = quoted_name
    columns = [q(n) for n in dict.fromkeys([*keep, *fields])]
    arrays = blocks.selectExpr(*columns, f"size({columns[0]}) AS __size")

    def rotated(run: int, field: str) -> str:
        # 1 … size-1, so that no row keeps its own value (a block of one row has to)
        offset = f"CAST({offset_draw(seed, run, field)} % greatest(__size - 1, 1) + 1 AS INT)"
        turned = f"concat(slice({q(field)}, {offset} + 1, __size - {offset}), slice({q(field)}, 1, {offset}))"
        return f"{turned} AS {q(shadow_name(field, run))}"

    places = [f"sequence(0, __size - 1) AS {q(position)}"] if position else []
    return arrays.selectExpr(*[q(n) for n in keep], *[rotated(r, f) for r in runs for f in fields], *places)


def block_rows(arrays: DataFrame) -> DataFrame:
    """The rows of array blocks."""
    return arrays.selectExpr(f"inline(arrays_zip({', '.join(quoted_name(n) for n in arrays.columns)}))")


def with_shadows(
    blocks: DataFrame, keep: Sequence[str], fields: Sequence[str], runs: Iterable[int], seed: int
) -> DataFrame:
    """Rows again: the ``keep`` columns and, for each run and field, a rotated copy."""
    return block_rows(shadow_arrays(blocks, keep, fields, runs, seed))
