"""Half-open validity intervals: updates close, split and replace what was valid, and equal neighbours become one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_FIRST, _LAST = "0001-01-01", "9999-12-31"


def apply_intervals(
    old: DataFrame, updates: DataFrame, key: str, fields: list[str], seq: str, start: str = "valid_from", end: str = "valid_to"
) -> DataFrame:
    """``key``, ``fields``, ``start`` and ``end`` after the updates, without overlaps.

    Within its interval an update replaces what was valid there, and a later one by ``seq`` an earlier one; old rows are
    older than all, and overlap only if they did before: the one that begins last counts. A null end is open, and so is a null start. An
    update with ``fields`` that are all null ends validity: nothing is valid in its interval. Empty intervals change
    nothing. The time line of a key is cut at every start and end; each piece takes the newest row that covers it, and pieces that
    touch and are equal are joined again.
    """
    low, high = F.lit(_FIRST).cast("date"), F.lit(_LAST).cast("date")
    own = old.select(key, F.struct(F.lit(0).alias("new"), F.lit(None).cast(dict(updates.dtypes)[seq]).alias("seq"), F.coalesce(start, low).alias("since")).alias("age"), *fields, start, end)
    more = updates.select(key, F.struct(F.lit(1).alias("new"), F.col(seq).alias("seq"), F.coalesce(start, low).alias("since")).alias("age"), *fields, start, end)
    rows = own.unionByName(more).withColumns({start: F.coalesce(start, low), end: F.coalesce(end, high)})
    rows = rows.filter(F.col(start) < F.col(end)).withColumn("_fields", F.struct(*fields)).select(key, "age", "_fields", start, end)
    cuts = rows.select(key, F.explode(F.array(start, end)).alias("_from")).distinct()
    pieces = cuts.withColumn("_to", F.lead("_from").over(W.partitionBy(key).orderBy("_from"))).filter("_to is not null")
    covered = pieces.join(rows, key).filter((F.col(start) <= F.col("_from")) & (F.col("_to") <= F.col(end)))
    newest = covered.groupBy(key, "_from", "_to").agg(F.max_by("_fields", F.struct("age", "_fields")).alias("_fields"))
    valid = newest.filter(" or ".join(f"_fields.`{f}` is not null" for f in fields))
    line = W.partitionBy(key).orderBy("_from")
    goes_on = (F.lag("_to").over(line) == F.col("_from")) & F.lag("_fields").over(line).eqNullSafe(F.col("_fields"))
    runs = valid.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(line))
    joined = runs.groupBy(key, "_run").agg(F.first("_fields").alias("_fields"), F.min("_from").alias(start), F.max("_to").alias(end))
    open_ended = {start: F.when(F.col(start) > low, F.col(start)), end: F.when(F.col(end) < high, F.col(end))}
    return joined.select(key, "_fields.*", start, end).withColumns(open_ended)
