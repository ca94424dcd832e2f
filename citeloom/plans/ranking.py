"""Places in an order, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order column per block.
BLOCK = 4096


def places(rows: DataFrame, by: list[str], coarse: dict[str, Column], order: str, within: list[str], out: str) -> DataFrame:
    """``rows`` with ``out``: the place (from 1) of each in its group ``by``, in order of ``coarse``, ``order``, ``within``.

    ``rows`` should be staged: they are read twice. Cells of one coarse value and a block of ``order`` are counted first;
    only these counts are summed up along the group, then each cell is numbered by itself. So a group with a third of all
    rows is ranked by as many tasks as it has cells.
    """
    keys = [*by, *[f"__{c}" for c in coarse]]
    cells = rows.withColumns({f"__{c}": e for c, e in coarse.items()} | {"__block": F.floor(F.col(order) / BLOCK)})
    count = cells.groupBy(*keys, "__block").agg(F.count("*").alias("__n"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    inside = count.withColumn("__inside", F.sum("__n").over(group.orderBy("__block")) - F.col("__n")).drop("__n")
    whole = count.groupBy(*keys).agg(F.sum("__n").alias("__n")) if keys else None
    if coarse:
        along = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*[f"__{c}" for c in coarse])
        before = whole.withColumn("__before", F.sum("__n").over(along) - F.col("__n")).drop("__n")
        inside = inside.join(before, keys)
    else:
        inside = inside.withColumn("__before", F.lit(0))
    own = F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(order, *within))
    placed = cells.join(inside, [*keys, "__block"]).withColumn(out, own + F.col("__inside") + F.col("__before"))
    return placed.drop("__block", "__inside", "__before", *[f"__{c}" for c in coarse])
