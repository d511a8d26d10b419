"""Order-dependent scans: one pass over each job's sorted rows, with a state of bounded size.

``sorted_scan`` deals rows out by job, sorts within partitions and runs a plain generator over the rows of each job as they stream
by. Nothing collects a job: memory is a batch of rows and whatever the generator keeps, time is linear in the rows, and a lost
executor repeats the partitions that it had.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
_OUT_ROWS = 10_000


def _values(column: pa.Array) -> Iterable:
    """Values of a column, lists of numbers as numpy arrays."""
    if pa.types.is_list(column.type) and pa.types.is_floating(column.type.value_type):
        offsets, flat = column.offsets.to_pylist(), column.values.to_numpy(zero_copy_only=False)
        return [flat[offsets[i] : offsets[i + 1]] if column[i].is_valid else None for i in range(len(column))]
    return column.to_pylist()


def sorted_scan(rows: DataFrame, order: list[str], scan: Callable[[Iterator[tuple]], Iterable[tuple]], schema: dict[str, str], key: str = "job_id") -> DataFrame:
    """``key`` and the columns of ``schema`` (name to type), as ``scan`` yields them for each job.

    ``scan`` gets the job's rows as tuples of the other columns of ``rows``, sorted by ``order`` (which should leave no ties), and yields
    tuples. It may stop early. A null key is a job as any other; a struct may be the key.
    """
    columns = [c for c in rows.columns if c != key]
    fields = list(schema.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def stream() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = batch.column(key).type
                yield from zip(batch.column(key).to_pylist(), zip(*(_values(batch.column(c)) for c in columns), strict=True), strict=True)

        def made(out: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array(values, t) for values, t in zip(zip(*out, strict=True), (kind, *(_TYPES[t] for _, t in fields)), strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=[key, *schema])

        out: list[tuple] = []
        for job, group in groupby(stream(), key=lambda r: r[0]):
            for r in scan(r[1] for r in group):
                out.append((job, *r))
                if len(out) >= _OUT_ROWS:
                    yield made(out)
                    out = []
        if out:
            yield made(out)

    ddl = ", ".join(f"`{c}` {t}" for c, t in fields)
    ready = rows.select(key, *columns).repartition(F.col(key)).sortWithinPartitions(key, *order)
    return ready.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {ddl}")
