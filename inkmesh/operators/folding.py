"""Sequential operators over keyed rows in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def keyed_fold(df: DataFrame, keys: list[str], order: list[str], fresh: Callable[[], object], step: Callable[[object, dict], tuple | None], fields: list[str], out: str, finish: Callable[[object, tuple], list[tuple]] | None = None) -> DataFrame:
    """Folds the rows of each key in ``order``: ``step(state, row)`` gives a row of ``out`` (or None), ``finish`` the rows at a key's end.

    One shuffle by key and a sort; rows then stream through the task, so a key of any size needs the memory of one
    batch and one state. A fold is sequential by definition: a key is one task's work.
    """
    names = [*keys, *[f for f in fields if f not in keys]]
    schema = to_arrow_schema(StructType.fromDDL(out))

    def rows_of(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], f.type) for k, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            made = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(len(names)))):
                own = row[: len(keys)]
                if own != key:
                    if key is not None and finish:
                        made.extend(finish(state, key))
                    key, state = own, fresh()
                if (x := step(state, dict(zip(names, row)))) is not None:
                    made.append(x)
            yield rows_of(made)
        if key is not None and finish:
            yield rows_of(finish(state, key))

    extra = [c for c in order if c not in names]
    return df.select(*names, *extra).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)
