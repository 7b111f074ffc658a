"""Grouped Python work on tables whose groups are many and small."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


TASKS_PER_CORE = 3


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key in one of a few tasks per core.

    Adaptive execution sizes tasks by bytes, which puts small rows with much work each into one
    task; partitions of a given number stay as they are.
    """
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(most, TASKS_PER_CORE * spark.sparkContext.defaultParallelism), *keys)


def _whole(batches, keys: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches as frames of whole groups."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        last = pdf[keys].iloc[-1].to_numpy()
        if held and not (held[0][keys].iloc[-1].to_numpy() == last).all() or not held:
            at = int((pdf[keys].to_numpy() == last).all(1).argmax())
            if held or at:
                yield pd.concat([*held, pdf.iloc[:at]], ignore_index=True)
            held = [pdf.iloc[at:]]
        else:
            held.append(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def map_groups(df: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema) -> DataFrame:
    """`fn(rows, group)` on frames of whole groups, many at a time; `group` numbers the rows' groups
    from 0 and rises.

    A call costs as much as many small groups do, so groups share it. A task reads its groups in
    order and holds a batch and the group at its end.
    """
    keys = list(keys)

    def run(batches):
        for pdf in _whole(batches, keys):
            at = pdf[keys].to_numpy()
            group = np.r_[0, (at[1:] != at[:-1]).any(1).cumsum()]
            yield fn(pdf, group)

    return dealt(df, *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


# A task sends its rows on when their arrays hold this many values.
VALUES_AT_ONCE = 1 << 21


def in_lots(rows: Iterable[tuple], columns: Sequence[str], most: int = 10_000) -> Iterator[pd.DataFrame]:
    """Rows as frames of a bounded number of array values and at most `most` rows."""
    lot, held = [], 0
    for row in rows:
        lot.append(row)
        held += sum(x.size for x in row if isinstance(x, np.ndarray))
        if held >= VALUES_AT_ONCE or len(lot) >= most:
            yield pd.DataFrame(lot, columns=list(columns))
            lot, held = [], 0
    if lot:
        yield pd.DataFrame(lot, columns=list(columns))


def map_each_group(
    df: DataFrame, keys: Sequence[str], fn: Callable[[dict[str, np.ndarray]], Iterable[tuple]], schema: str, order: Sequence[str] = ()
) -> DataFrame:
    """`fn(columns)` for each group, which returns the group's output rows.

    Groups that hold a few arrays each come in one frame and leave in lots, so a group costs what
    `fn` does with it and no call of its own. Rows of a group come in the order of `order`; a task
    holds a batch, the group at its end and a lot.
    """
    keys, names = list(keys), [c.split()[0] for c in schema.split(", ")]

    def rows(batches):
        for pdf in _whole(batches, keys):
            at = pdf[keys].to_numpy()
            starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(1)])
            columns = {c: pdf[c].to_numpy() for c in pdf.columns}
            for a, b in zip(starts, np.r_[starts[1:], len(pdf)]):
                yield from fn({c: v[a:b] for c, v in columns.items()})

    return dealt(df, *keys).sortWithinPartitions(*keys, *order).mapInPandas(lambda batches: in_lots(rows(batches), names), schema)
