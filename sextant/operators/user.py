"""Aggregators of the user's own: start, add, merge, finish, with partial states before the shuffle."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups whose states a task holds before it hands them on.
HELD = 10_000


class Aggregator:
    """What a user writes. States must pickle; ``merge`` must not mind in which order or grouping states meet.

    ``result`` is the schema of what ``finish`` returns, as a tuple.
    """

    result: str

    def start(self) -> Any:
        raise NotImplementedError

    def add(self, state: Any, *values: Any) -> Any:
        raise NotImplementedError

    def merge(self, a: Any, b: Any) -> Any:
        raise NotImplementedError

    def finish(self, state: Any) -> tuple:
        raise NotImplementedError


def aggregate(rows: DataFrame, by: Sequence[str], values: Sequence[str], how: Aggregator) -> DataFrame:
    """``by`` and the fields of ``how.result``, one row a group.

    Each task folds its rows into one state a group and hands states on when it
    holds many; only states are shuffled, so a group of any size costs one state
    a task. States of a group then come in a row and are merged as they stream by,
    never gathered. Null keys are a group; without ``by`` there is one row, also
    for an empty table.
    """
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(by)]
    narrow = rows.select(*keys, *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)])
    n, key_names = len(by), [f"k{i}" for i in range(len(by))]
    key_schema = ", ".join(f"k{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(by))
    partial = ", ".join(x for x in (key_schema, "state binary") if x)
    final = ", ".join(x for x in (key_schema, how.result) if x)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Any] = {}
        types: list = []

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], types[i]) for i in range(n)]
            made = pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps(s) for s in held.values()], pa.binary())], names=[*key_names, "state"])
            held.clear()
            return made

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(n)]
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*columns, strict=True):
                key = row[:n]
                if key not in held:
                    held[key] = how.start()
                held[key] = how.add(held[key], *row[n:])
            if len(held) > HELD:
                yield out()
        if held:
            yield out()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out_schema)
        done: list[tuple] = []
        key, state, begun = None, None, False

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
            done.clear()
            return made

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*columns, strict=True):
                other = pickle.loads(row[n])
                if begun and row[:n] == key:
                    state = how.merge(state, other)
                    continue
                if begun:
                    done.append((*key, *how.finish(state)))
                key, state, begun = row[:n], other, True
            if done:
                yield out()
        if not begun and not n:
            key, state, begun = (), how.start(), True
        if begun:
            done.append((*key, *how.finish(state)))
            yield out()

    states = narrow.mapInArrow(fold, partial)
    spread = states.repartition(*key_names).sortWithinPartitions(*key_names) if n else states.coalesce(1)  # a state a task
    out_schema = spread.sparkSession.createDataFrame([], final).schema
    named = [*by, *[f.name for f in out_schema.fields[n:]]]
    return spread.mapInArrow(join, final).toDF(*named)
