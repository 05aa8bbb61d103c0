"""Rows of whole documents, handed to Python in batches of documents.

Rows are first collected by document, where they are if they have been dealt out by it; a batch then holds many documents,
none of them in parts, so that no document costs a call of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collected(rows: DataFrame, fields: list, keys=("doc_id",)) -> DataFrame:
    """keys, xs: the fields of a document's rows, in no order."""
    return rows.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("xs"))


def flat(batch: pa.RecordBatch, name: str = "xs") -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The document (its place in the batch) of each row of the batch's documents, and the rows' fields."""
    lists = batch.column(batch.schema.get_field_index(name))
    xs = lists.flatten()
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), {f.name: xs.field(k) for k, f in enumerate(xs.type)}


#: Rows of a piece of a batch.
PIECE = 20_000


def pieces(batch: pa.RecordBatch, name: str = "xs", rows: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of whole documents with at most so many rows, or of one document with more."""
    offsets = batch.column(batch.schema.get_field_index(name)).offsets.to_numpy()
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + rows, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def stacked(batches: Iterator[pa.RecordBatch], n_rows: str, rows: int = PIECE) -> Iterator[pa.RecordBatch]:
    """As batches of collected(), from rows of which each document's stand together, as behind a window over it: the first column is the document, n_rows names the number of its rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        ends = np.flatnonzero(_starts(batch.column(0)))[1:]
        if n >= rows and len(ends):
            yield _as_lists([*held[:-1], batch.slice(0, ends[-1])], n_rows)
            held, n = [batch.slice(ends[-1])], batch.num_rows - ends[-1]
    if n:
        yield _as_lists(held, n_rows)


def _starts(ids: pa.Array) -> np.ndarray:
    """Where rows begin a document."""
    ids = ids.to_numpy(zero_copy_only=False)
    return np.append(np.ones(min(len(ids), 1), bool), ids[1:] != ids[:-1])


def _as_lists(held: list[pa.RecordBatch], n_rows: str) -> pa.RecordBatch:
    batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    first = np.flatnonzero(_starts(batch.column(0)))
    if not np.array_equal(np.diff(np.append(first, batch.num_rows)), batch.column(n_rows).to_numpy()[first]):
        raise ValueError("a document's rows do not stand together")
    xs = pa.StructArray.from_arrays(batch.columns[1:], names=batch.schema.names[1:])
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first)), pa.ListArray.from_arrays(pa.array(np.append(first, batch.num_rows), pa.int32()), xs)], [batch.schema.names[0], "xs"])


def tuples(batch: pa.RecordBatch, name: str) -> Iterator[list[tuple]]:
    """The rows of each document of the batch."""
    of, columns = flat(batch, name)
    xs = list(zip(*(c.to_pylist() for c in columns.values()), strict=True))
    ends = np.searchsorted(of, np.arange(batch.num_rows + 1)).tolist()
    return (xs[a:b] for a, b in pairwise(ends))


def folded(rows: DataFrame, fields: list[str], fold: Callable[[list[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """doc_id and what fold gives for a document's rows: it gets the tuples of their fields in order, and yields tuples of the schema's other columns."""
    names = [c.split()[0] for c in schema.split(", ")]

    def batches(parts):
        for batch in parts:
            ids = batch.column(0).to_pylist()
            out = [(doc, *r) for doc, xs in zip(ids, tuples(batch, "xs"), strict=True) for r in fold(sorted(xs, key=lambda x: x[0]))]
            types = [pa.int64(), *({"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[c.split()[1]] for c in schema.split(", "))]
            values = list(zip(*out, strict=True)) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["doc_id", *names])

    return collected(rows, fields).mapInArrow(batches, f"doc_id long, {schema}")
