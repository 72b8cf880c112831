"""Table maintenance in batches: read, transform, write. No row is changed in place."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.keys import stable_id
from tickerloom.operators.dedupe import keep_last_in_batch
from tickerloom.operators.validate import duplicate_keys


def merge_by_key(
    old: DataFrame,
    new: DataFrame,
    key: str,
    seq: list[str],
    keep_old: list[str] | None = None,
    drop_unmatched: bool = False,
) -> DataFrame:
    """Upsert: a new row overwrites every field of its key, nulls included, except the ``keep_old`` columns.

    Old rows pass by an anti join and aren't shuffled when the batch is small; of the old table only the kept columns of the
    batch's keys are joined. ``drop_unmatched`` leaves the batch's keys alone.
    """
    kept = keep_old or []
    batch = keep_last_in_batch(new, [key], seq).select(*[F.col(c) for c in old.columns])
    if kept:
        known = old.select(F.col(key), F.struct(*kept).alias("_old"))
        joined = batch.join(known, key, "left")
        # A known row keeps its value even if that is null.
        value = {c: F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(c)).alias(c) for c in kept}
        batch = joined.select(*[value.get(c, F.col(c)) for c in old.columns])
    if drop_unmatched:
        return batch
    return old.join(batch.select(key), key, "left_anti").unionByName(batch)


def upsert_articles(old: DataFrame, batch: DataFrame, retrieved_at: Any, seq: list[str]) -> DataFrame:
    """Upsert by URL. Known articles keep their id, every written row gets the given retrieval time."""
    stamped = (
        batch.withColumn("id", stable_id(F.col("url")))
        .withColumn("url_canonical", F.col("url"))
        .withColumn("_seq", F.struct(*seq))
        .withColumn("retrieved_at", F.lit(retrieved_at).cast("timestamp"))
    )
    return merge_by_key(old, stamped, "url", ["_seq"], keep_old=["id"])


def upsert_embeddings(old: DataFrame, batch: DataFrame, seq: list[str]) -> DataFrame:
    return merge_by_key(old, batch, "article_id", seq)


def replace_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """Every article in the batch gets exactly its new links; other articles keep theirs."""
    touched = new.select("article_id").distinct()
    return old.join(touched, "article_id", "left_anti").unionByName(new)


def append(old: DataFrame, new: DataFrame, keys: list[str], on_conflict: str = "error") -> DataFrame:
    """Append rows under a key. ``ignore`` keeps the old row of a taken key, ``replace`` the new one.

    Of rows that repeat a key inside the batch one is appended: the first by its other columns under ``ignore``, the
    last under ``replace``. ``error`` runs a job at once that fails when a key is taken or repeats inside the batch.
    """
    if on_conflict in ("ignore", "replace"):
        rest = F.struct(*[c for c in new.columns if c not in keys])
        pick = F.min(rest) if on_conflict == "ignore" else F.max(rest)
        once = new.groupBy(*keys).agg(pick.alias("_rest")).select(*keys, "_rest.*") if set(new.columns) - set(keys) else new.distinct()
        if on_conflict == "ignore":
            return old.unionByName(once.join(old.select(*keys), keys, "left_anti"))
        return old.join(once.select(*keys), keys, "left_anti").unionByName(once)
    both = old.select(*keys).unionByName(new.select(*keys))
    if not duplicate_keys(both, keys).isEmpty():
        raise ValueError(f"duplicate key on append: {', '.join(keys)}")
    return old.unionByName(new)


def with_signal_ids(signals: DataFrame) -> DataFrame:
    """Signals as inserted, with the id that their ticker and time determine."""
    return signals.withColumn("id", stable_id(F.col("ticker"), F.unix_seconds("ts").cast("string")))


def update_by_key(
    old: DataFrame, updates: DataFrame, key: str, seq: list[str] | None = None, set_fields: str | None = None
) -> DataFrame:
    """Set the update columns, nulls included; columns the table lacks are ignored, unknown keys change nothing.

    Of several updates of a key the last by ``seq`` counts. ``set_fields`` names a column that lists, per update, the
    fields it sets; without it every update sets all of its columns.
    """
    fields = [c for c in updates.columns if c not in (key, set_fields) and c in old.columns]
    listed = F.col(set_fields) if set_fields else F.array(*[F.lit(c) for c in fields]).cast("array<string>")
    last = keep_last_in_batch(updates, [key], seq or [c for c in updates.columns if c != key])
    renamed = last.select(F.col(key), listed.alias("_set"), *[F.col(c).alias(f"_u_{c}") for c in fields])

    def value(c: str) -> Column:
        return F.when(F.array_contains("_set", c), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c)

    return old.join(renamed, key, "left").select(*[value(c) if c in fields else F.col(c) for c in old.columns])


def edit_aliases(tickers: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply (symbol, add, remove) edits to the alias lists.

    ``changed`` is false when the ticker is unknown or the alias to remove is not there.
    """
    current = F.coalesce("aliases", F.array().cast("array<string>"))
    joined = tickers.select("symbol", current.alias("aliases"), F.lit(True).alias("_known")).join(
        edits, "symbol", "right"
    )
    known = F.coalesce("_known", F.lit(False))
    added = F.when(F.col("add").isNull(), F.col("aliases")).otherwise(F.array_union("aliases", F.array("add")))
    removed = F.when(F.col("remove").isNull(), added).otherwise(F.array_remove(added, F.col("remove")))
    removable = F.col("remove").isNull() | F.coalesce(F.array_contains("aliases", F.col("remove")), F.lit(False))
    return joined.select("symbol", removed.alias("aliases"), (known & removable).alias("changed"))


def delete_by_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def delete_where(df: DataFrame, cond: Column) -> DataFrame:
    """Rows for which the condition is not true."""
    return df.filter(~F.coalesce(cond, F.lit(False)))


def delete_by_ticker(df: DataFrame, ticker: str) -> DataFrame:
    return delete_where(df, F.col("ticker") == ticker)


def delete_by_range(df: DataFrame, start: Any, end: Any, ts: str = "ts") -> DataFrame:
    """Closed interval."""
    bounds = [F.lit(b).cast("timestamp") for b in (start, end)]
    return delete_where(df, F.col(ts).between(*bounds))


def delete_old_articles(
    articles: DataFrame, children: dict[str, DataFrame], cutoff: Any
) -> dict[str, DataFrame]:
    """Articles before the cutoff go, and with them the rows of every child table."""
    old = F.col("published_at") < F.lit(cutoff).cast("timestamp")
    gone = articles.filter(old).select(F.col("id").alias("article_id"))
    kept = {name: delete_by_keys(child, gone, "article_id") for name, child in children.items()}
    return {"article": delete_where(articles, old), **kept}


def delete_signals_cascade(signals: DataFrame, contribs: DataFrame, cond: Column) -> tuple[DataFrame, DataFrame]:
    gone = signals.filter(cond).select(F.col("id").alias("signal_id"))
    return delete_where(signals, cond), delete_by_keys(contribs, gone, "signal_id")


def retain(df: DataFrame, ts: str, days: int, as_of: Any) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``."""
    return df.filter(F.col(ts) >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))
