"""Python rules over rows."""

from __future__ import annotations

import pyarrow as pa

from quirework.operators.rows import SLICE, sliced


def test_a_large_batch_is_taken_in_slices():
    """However large Spark's batch is, only a slice of it and its rows are Python objects at a time; rows without output are no error."""
    live = []

    def rule(i, t):
        live.append(i)
        return [] if i % 3 else [(i, t), (i, None)]

    read = sliced(rule, ["i", "t"], pa.schema([("i", pa.int64()), ("t", pa.string())]))
    n = 3 * SLICE + 7
    batch = pa.RecordBatch.from_pydict({"t": [None if i == 3 else f"x{i}" for i in range(n)], "i": list(range(n))})
    out = []
    for k, part in enumerate(read(iter([batch, batch.slice(0, 0)])), 1):
        assert len(live) == min(k * SLICE, n)
        out += list(zip(*part.to_pydict().values()))
    assert out == [row for i in range(0, n, 3) for row in ((i, None if i == 3 else f"x{i}"), (i, None))]
