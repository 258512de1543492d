"""Rows carried as one column, so that an operator's own columns can't clash with a table's."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """The column of that very name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, name: str = "row") -> Column:
    """All columns of ``docs`` as one struct."""
    return F.struct(*map(quoted, docs.columns)).alias(name)


def unpacked(columns: list[str], name: str = "row") -> list[Column]:
    """The packed columns of these names."""
    return [F.col(name).getField(c).alias(c) for c in columns]


def arrow_filter(docs: DataFrame, run) -> DataFrame:
    """``docs`` without some rows. ``run()`` gives, in a task, a function from texts to whether each stays.

    Columns are numbered meanwhile, as Arrow functions take no names with dots.
    """
    names, at = [f"c{i}" for i in range(len(docs.columns))], docs.columns.index("text")

    def stay(batches):
        keep = run()
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))

    numbered = docs.toDF(*names)
    return numbered.mapInArrow(stay, numbered.schema).toDF(*docs.columns)
