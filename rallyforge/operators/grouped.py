"""Vectorised processing of sorted groups.

``map_sorted_groups`` shuffles once by the group keys, sorts within partitions and streams Arrow batches to a numpy
function that gets many complete groups at a time. Compared with ``applyInPandas`` there is one Python call for some
hundred thousand rows instead of one for each group, and no pandas conversion. A task never holds more than
``flush_rows`` rows plus one group, so callers must choose keys whose groups have a bound (a source is cut into
chunks of frames or of time for that).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows gathered before the function is called (whole groups only).
FLUSH_ROWS = 150_000


class Groups:
    """Complete, sorted groups: ``start[i]`` is the first row of group i, ``start[-1]`` the number of rows."""

    def __init__(self, table: pa.Table, start: np.ndarray):
        self.table, self.start = table, start

    def __len__(self) -> int:
        return len(self.start) - 1

    def column(self, name: str) -> np.ndarray:
        """Numbers as numpy; NULL becomes NaN in floating columns."""
        c = self.table.column(name)
        if pa.types.is_timestamp(c.type):
            c = c.cast(pa.int64())
        if c.null_count and pa.types.is_integer(c.type):
            c = c.cast(pa.float64())
        return c.to_numpy()

    def of_row(self) -> np.ndarray:
        """Group number of each row."""
        return np.repeat(np.arange(len(self)), np.diff(self.start))

    def keep(self, mask: np.ndarray) -> Groups:
        """The rows of mask; groups stay, even those left without rows."""
        counts = np.concatenate([[0], np.cumsum(mask)])
        return Groups(self.table.filter(pa.array(mask)), counts[self.start])

    def take(self, names: list[str], rows: np.ndarray) -> dict[str, pa.ChunkedArray]:
        part = self.table.select(names).take(pa.array(rows))
        return {n: part.column(n) for n in names}


def map_sorted_groups(
    df: DataFrame,
    keys: list[str],
    order: list,
    fn: Callable[[Groups], dict],
    schema: StructType | str,
    flush_rows: int = FLUSH_ROWS,
) -> DataFrame:
    """fn gets Groups and returns columns by name (numpy or Arrow), in the order of schema."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    keyed = df.select(*columns, F.xxhash64(*keys).alias("__g1"), F.hash(*keys).alias("__g2"))
    # two hashes beside the keys: a boundary is found from numbers alone, and two groups would have to agree in 96 bits
    parts = keyed.repartition("__g1").sortWithinPartitions("__g1", "__g2", *keys, *order)
    names = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fieldNames()

    def flush(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(tables).combine_chunks()
        if not t.num_rows:
            return
        a, b = t.column("__g1").to_numpy(), t.column("__g2").to_numpy()
        cut = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        out = fn(Groups(t, np.concatenate([[0], cut, [t.num_rows]])))
        if out is not None and len(out[names[0]]):
            made = pa.table({n: out[n] for n in names})
            yield from made.to_batches(max_chunksize=65_536)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held.append(t)
            rows += t.num_rows
            if rows < flush_rows:
                continue
            a, b = t.column("__g1").to_numpy(), t.column("__g2").to_numpy()
            last = (a == a[-1]) & (b == b[-1])
            tail = int(last[::-1].argmin()) if not last.all() else t.num_rows
            if tail == t.num_rows:
                continue  # the open group fills this batch; go on until it ends
            held[-1] = t.slice(0, t.num_rows - tail)
            yield from flush(held)
            held, rows = [t.slice(t.num_rows - tail)], tail
        if held:
            yield from flush(held)

    return parts.mapInArrow(run, schema)


def newest_of_key(g: Groups, key: str = "frame") -> Groups:
    """One row for each key of a group: rows must be sorted by key, then newest first."""
    k = g.column(key)
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    first[g.start[:-1][np.diff(g.start) > 0]] = True
    return g.keep(first)
