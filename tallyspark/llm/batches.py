"""Arrow batches in tasks: groups of rows that follow each other."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def consecutive(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Each run of rows with equal integer ``keys``, from batches sorted by them.

    A run is held whole, so its size must be bounded where it is made.
    """
    current, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change).tolist()
        for at, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(c[at].item() for c in columns)
            if key != current:
                if parts:
                    yield current, pa.Table.from_batches(parts)
                current, parts = key, []
            parts.append(batch.slice(at, end - at))
    if parts:
        yield current, pa.Table.from_batches(parts)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of ``batches`` sorted by integer ``keys``, in tables that part no rows with equal keys.

    Only the last run of a batch waits for the next one, so its size must be bounded where it is made.
    """
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = not held or any(held[-1].column(k)[-1].as_py() != c[0].item() for k, c in zip(keys, columns, strict=True))
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        if len(starts):
            cut = int(starts[-1])
            done = [*held, batch.slice(0, cut)]
            if sum(b.num_rows for b in done):
                yield pa.Table.from_batches(done)
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
