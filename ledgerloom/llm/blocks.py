"""Groups of rows dealt into blocks of a bounded size, so that no group has to fit in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, partitions, trimmed


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salt: str, how: str = "inner", parts: int = 16) -> DataFrame:
    """left joined with right, which has one row a key at most: the rows of a very common key go to `parts` tasks, by a
    hash of the column salt, and right's rows to each of them."""
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(salt, F.lit("join")), F.lit(parts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


FEW = 100_000  # large groups that are sent to all tasks; more are joined


def pair_blocks(rows: DataFrame, keys: list[str], salt: str, limit: int) -> DataFrame:
    """rows with i, j, sub: a group of over limit rows is cut into parts by a hash of salt; the block (i, j) holds the
    parts i and j, so that each pair of the group meets in one block (or, within a part i, in the block (i, i))."""
    large = cut(rows.groupBy(*keys).count().where(F.col("count") > limit).select(*keys, F.ceil(F.col("count") / limit).cast("int").alias("parts")))
    n = large.count()
    if n:
        found = rows.join(F.broadcast(large), keys, "left") if n <= FEW else salted_join(rows, large, keys, salt, "left")
        dealt = found.select(*rows.columns, F.coalesce("parts", F.lit(1)).alias("parts"))
    else:
        dealt = rows.withColumn("parts", F.lit(1))
    dealt = dealt.withColumn("sub", F.pmod(F.xxhash64(salt, F.lit("part")), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.withColumn("other", other).withColumn("i", F.least("sub", "other")).withColumn("j", F.greatest("sub", "other"))
    return dealt.drop("parts", "other")


def grouped(dealt: DataFrame, keys: list[str], work: Callable, schema: str, columns: list[str]) -> DataFrame:
    """work(arrays, starts, ends) for the whole groups in a batch; arrays: columns as numpy arrays or lists (binary).

    The rows come sorted by keys; a group that a batch ends in is carried over. Groups of one row are left out.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            rest = None
            if not table.num_rows:
                continue
            change = _changes(table, keys)
            rest = table.slice(int(change[-1]))
            yield from _whole(table.slice(0, int(change[-1])), change, columns, work)
        if rest is not None:
            yield from _whole(rest, _changes(rest, keys), columns, work)

    return dealt.select(*columns).repartition(partitions(dealt.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(trimmed(stream), schema)


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _whole(table: pa.Table, change: np.ndarray, columns: list[str], work: Callable) -> Iterator[pa.RecordBatch]:
    n = table.num_rows
    if not n:
        return
    starts = change[change < n]
    ends = np.r_[starts[1:], n]
    several = ends - starts > 1
    if not several.any():
        return
    arrays = {c: table.column(c).to_pylist() if pa.types.is_binary(table.schema.field(c).type) else table.column(c).to_numpy() for c in columns}
    yield from work(arrays, starts[several], ends[several])
