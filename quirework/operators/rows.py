"""Python rules over rows that each give any number of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: Rows that are Python objects at a time, however many Spark sends in a batch.
SLICE = 256


def sliced(rule: Callable[..., Iterable[tuple]], names: list[str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: ``rule`` takes the values of the columns ``names`` and gives tuples of ``schema``."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                given = zip(*[part.column(part.schema.get_field_index(c)).to_pylist() for c in names], strict=True)
                rows = [row for values in given for row in rule(*values)]
                columns = zip(*rows, strict=True) if rows else [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return read
