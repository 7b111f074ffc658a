"""Join shapes that hold up when one key carries a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row in a join: eight, eight a column, and eight and its length for a string."""
    strings = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) + 8 for f in df.schema if f.dataType.typeName() == "string"]
    return reduce(add, strings, F.lit(8 * (1 + len(df.columns)))).cast("bigint")


def measured_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str], big_bytes: int, small_bytes: int) -> DataFrame:
    """Inner `salted_join` that broadcasts a side only if its rows, as measured, are below the threshold.

    The optimiser goes by the size of files, in which rows take up a fraction of the driver's memory.
    """
    most = big.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if min(big_bytes, small_bytes) > most:
        return salted_join(big.hint("merge"), small, on, spread)
    if small_bytes <= big_bytes:
        return big.join(F.broadcast(small), list(on))
    return F.broadcast(big).join(small, list(on))


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join a big table to a per-key table without sending a hot key to one task.

    With adaptive execution this is a plain join: a `small` below the broadcast threshold is
    broadcast at its true size, and otherwise the partitions of a hot key are split at run time.
    Without it, `spread` names columns of `big` that vary inside a hot key (pixel coordinates, row
    ids); they choose one of `salts` sub-keys, `small` carries a copy of its row per sub-key, and
    both sides shuffle, so the copies are never broadcast. Only `inner` and `left` keep exactly
    one match per big row under replication.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"salted_join supports inner and left, got {how!r}")
    conf = big.sparkSession.conf
    if conf.get("spark.sql.adaptive.enabled") == "true" and conf.get("spark.sql.adaptive.skewJoin.enabled") == "true":
        return big.join(small, list(on), how)
    left = big.selectExpr("*", f"int(pmod(xxhash64({', '.join(spread)}), {salts})) as _salt")
    right = small.selectExpr("*", f"explode(sequence(0, {salts - 1})) as _salt")
    return left.join(right.hint("merge"), [*on, "_salt"], how).drop("_salt")
