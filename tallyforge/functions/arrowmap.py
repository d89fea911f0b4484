"""Arrow-batched row expansion: the one bridge to Python that custom operators use."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import tallyforge
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

# functions travel to the executors by value, so that the package need not be installed there
cloudpickle.register_pickle_by_value(tallyforge)


def encodable(value: Any) -> Any:
    """The value with texts that UTF-8 can hold: surrogate pairs become their character, lone ones the replacement character."""
    if isinstance(value, str):
        return value.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    if isinstance(value, (list, tuple)):
        return type(value)(encodable(v) for v in value)
    return value


def flat_map(
    df: DataFrame,
    columns: list[str],
    make: Callable[[], Callable[..., Iterable[tuple]]],
    schema: str,
    rows_per_batch: int = 2048,
) -> DataFrame:
    """Rows of ``schema`` made from each input row by ``make()(*values)``.

    ``make`` runs once per task, so that tables it needs are built once; only ``columns`` reach Python.
    Output leaves in batches of about ``rows_per_batch`` rows, so one input row with many results never holds
    a whole partition's results in memory. Half characters (lone surrogates), which an escape may give, leave as U+FFFD.
    """
    out: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, buffer = make(), []
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                for made in each(*values):
                    buffer.append(made)
                    if len(buffer) >= rows_per_batch:
                        yield pack(buffer)
                        buffer = []
        if buffer:
            yield pack(buffer)

    def column(values: tuple, kind: pa.DataType) -> pa.Array:
        try:
            return pa.array(values, type=kind)
        except UnicodeEncodeError:
            return pa.array([encodable(v) for v in values], type=kind)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([column(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return df.select(*[df[c] for c in columns]).mapInArrow(run, out)
