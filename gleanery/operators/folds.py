"""Running state over the rows of a group, for rules that no window expresses."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

from gleanery.session import ship_package


def scan(rows: DataFrame, by: list[str], order: list[str], inputs: list[str], start: Callable[[], object], step: Callable, name: str, kind: DataType) -> DataFrame:
    """``rows`` with a column ``name``: what ``step(state, *inputs)`` gives next to the new state, in order within a group.

    Groups are dealt by key and stream through their task in sorted order: work is linear, and memory is one
    batch and one state, however long a group is.
    """
    ship_package(rows.sparkSession)
    columns = rows.columns
    at_keys, at_inputs = [columns.index(c) for c in by], [columns.index(c) for c in inputs]
    held = pa.field(name, to_arrow_type(kind))

    def run(batches):
        now, state = None, None
        for batch in batches:
            out = []
            values = [batch.column(i).to_pylist() for i in at_keys + at_inputs]
            for row in zip(*values):
                key = row[: len(at_keys)]
                if key != now:
                    now, state = key, start()
                state, got = step(state, *row[len(at_keys) :])
                out.append(got)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, held.type)], [*batch.schema.names, name])

    dealt = rows.repartition(*map(F.col, by)).sortWithinPartitions(*by, *order)
    return dealt.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, kind)]))
