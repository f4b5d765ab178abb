"""A log of edits that only grows: what each click changed, with the value before and after.

A row is (seq, kind, key, before, after): one click (``seq``) changes the value of any number of keys of any kind (groups,
picks, favourites, tags, rows as JSON). Null stands for a value that isn't there. States are views of the log: the latest
value of each key, or that as of any click; only keys that a click touches are ever looked at again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["kind", "key"]


def state(log: DataFrame, seq: int | None = None) -> DataFrame:
    """(kind, key, value, seq) of all keys after a click, or after all; a key whose value was taken away has none."""
    rows = log if seq is None else log.where(F.col("seq") <= seq)
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct("after", "seq"), "seq").alias("x"))
    return last.select(*KEY, F.col("x.after").alias("value"), F.col("x.seq").alias("seq")).where("value is not null")


def entries(log: DataFrame, edits: DataFrame) -> DataFrame:
    """Log rows of new edits (seq, kind, key, after), later than all of the log; of a click's edits of one key the least counts.

    What was before is the edit before within ``edits``, or else the log's; only touched keys are looked up. Edits that
    change nothing are no rows.
    """
    one = edits.groupBy("seq", *KEY).agg(F.min("after").alias("after"))
    touched = one.select(*KEY).distinct()
    was = state(log.join(touched, KEY, "left_semi")).select(*KEY, F.col("value").alias("_was"))
    order = Window.partitionBy(*KEY).orderBy("seq")
    lined = one.join(was, KEY, "left").withColumn("_i", F.row_number().over(order))
    before = F.when(F.col("_i") == 1, F.col("_was")).otherwise(F.lag("after").over(order))
    made = lined.withColumn("before", before).select("seq", *KEY, "before", "after")
    return made.where(~F.col("before").eqNullSafe(F.col("after")))


def undo(log: DataFrame, clicks: DataFrame, seq: int) -> tuple[DataFrame, DataFrame]:
    """(rows, conflicts): log rows, under the new number ``seq``, that take back clicks (seq), in any number and order.

    A key gets the value from before the earliest of the clicks after which nothing else changed it. Keys that another
    click changed later are left as they are and returned as (seq, kind, key). Taking back what was taken back puts the
    edit there again, as an undo is a click like any other.
    """
    chosen = clicks.select("seq").distinct().withColumn("_mine", F.lit(True))
    touched = log.join(clicks, "seq", "left_semi").select(*KEY).distinct()
    rows = log.join(touched, KEY, "left_semi").join(chosen, "seq", "left").withColumn("_mine", F.coalesce("_mine", F.lit(False)))
    other = F.max(F.when(~F.col("_mine"), F.col("seq"))).over(Window.partitionBy(*KEY))
    rows = rows.withColumn("_other", F.coalesce(other, F.lit(-1)))
    free = rows.where(F.col("_mine") & (F.col("seq") > F.col("_other")))
    back = free.groupBy(*KEY).agg(F.min_by("before", "seq").alias("after"), F.max_by("after", "seq").alias("before"))
    made = back.where(~F.col("before").eqNullSafe(F.col("after"))).select(F.lit(seq).cast("long").alias("seq"), *KEY, "before", "after")
    return made, rows.where(F.col("_mine") & (F.col("seq") < F.col("_other"))).select("seq", *KEY)


def compact(log: DataFrame, upto: int) -> DataFrame:
    """The log with all clicks up to a number folded into one row a key, under that key's last number: states as of later
    numbers stay as they are, earlier ones and undoing the folded clicks aren't possible any more."""
    old = log.where(F.col("seq") <= upto).groupBy(*KEY)
    folded = old.agg(F.max("seq").alias("seq"), F.min_by("before", "seq").alias("before"), F.max_by("after", "seq").alias("after"))
    kept = folded.where(F.col("before").isNotNull() | F.col("after").isNotNull()).select("seq", *KEY, "before", "after")
    return kept.unionByName(log.where(F.col("seq") > upto))


def refreshed(view: DataFrame, log: DataFrame, since: int) -> DataFrame:
    """view (kind, key, value) as of click ``since``, brought up to date: only keys with later rows are derived again."""
    later = log.where(F.col("seq") > since)
    now = later.groupBy(*KEY).agg(F.max_by("after", "seq").alias("value"))
    return view.select(*KEY, "value").join(now, KEY, "left_anti").unionByName(now.where("value is not null"))
