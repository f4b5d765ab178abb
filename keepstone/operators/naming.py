"""Names that are unique and stay: free slots of a stem, and numbered paths."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepstone.operators.ordering import running_sums
from keepstone.sources.shared import stored


def assign_names(new: DataFrame, taken: DataFrame, stem: str, order: list[str], name: str = "name") -> DataFrame:
    """new plus ``name``: the stem, or stem_1, stem_2 and so on, whichever are free, in order; ``taken`` has (name).

    Row k of a stem gets number k plus the used numbers that it passes: the j-th used number u is passed from row u - j on,
    so rows and these places are counted in one order, without a list of free numbers anywhere.
    """
    number = F.regexp_extract("name", "_([1-9][0-9]{0,8})$", 1)
    slots = taken.select(F.col("name").alias("full"), F.regexp_replace("name", "_[0-9]+$", "").alias("cut"), number.alias("number"))
    # A name is slot 0 of itself; if it ends in a number it is also that slot of what stands before.
    zero = slots.select(F.col("full").alias("_stem"), F.lit(0).cast("long").alias("_slot"))
    more = slots.where("number != ''").select(F.col("cut").alias("_stem"), F.col("number").cast("long").alias("_slot"))
    of = Window.partitionBy("_stem")
    used = zero.unionByName(more).distinct().withColumn("_j", F.row_number().over(of.orderBy("_slot")) - 1)
    rows = new.select(F.col(stem).alias("_stem"), F.struct(*new.columns).alias("_row"), F.struct(*order).alias("_order"))
    rows = rows.withColumn("_at", (F.row_number().over(of.orderBy("_order")) - 1).cast("long"))
    both = rows.select("_stem", "_at", F.lit(1).alias("_kind"), "_row").unionByName(
        used.select("_stem", (F.col("_slot") - F.col("_j")).alias("_at"), F.lit(0).alias("_kind")), allowMissingColumns=True
    )
    passed = F.sum(1 - F.col("_kind")).over(of.orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    slot = F.col("_at") + F.col("_passed")
    made = F.when(slot == 0, F.col("_stem")).otherwise(F.concat("_stem", F.lit("_"), slot.cast("string")))
    return both.withColumn("_passed", passed).where("_kind = 1").select("_row.*", made.alias(name))


#: Digits of a number that can be reached.
_DIGITS = r"([2-9]|[1-9][0-9]{1,8})"


def number_paths(df: DataFrame, path: str, order: list[str], suffix: str = "_", out: str = "target") -> DataFrame:
    """df plus ``out``: rows take their path in order, or, where that is taken, the first free of suffix 2, 3 and so on
    before the extension. A name that a path has by nature is taken as any other, by whichever row comes first.

    ``order`` tells all rows apart; paths aren't null. Names only meet within a stem: the further rows of ``a.jpg`` look
    at ``a_2.jpg``, ``a_3.jpg`` in turn, and pass one if a row that has it by nature came before. So a stem's further
    rows are counted in ranges (a stem may be most of the table), the passed numbers are found by one walk over those
    numbers that paths have by nature, and the walk sees no row beyond the largest of them. A path of which the stem
    took the name has only further rows; stems are settled before what they can take, level by level. Rows of a path
    that stands once, and that no stem can reach, are only counted.
    """
    spark = df.sparkSession
    mark = re.escape(suffix)
    tail = F.regexp_extract("_base", f"{mark}{_DIGITS}$", 1)
    parent = F.concat(F.expr(f"left(_base, length(_base) - length(_tail) - {len(suffix)})"), F.col("_ext"))
    level = F.size(F.split(F.regexp_extract("_base", f"((?:{mark}{_DIGITS})*)$", 1), mark)) - 1
    names = df.select(F.col(path).alias("_path"), F.struct(*order).alias("_at")).groupBy("_path").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    names = names.withColumn("_ext", F.regexp_extract("_path", r"(\.[^./]*)$", 1)).withColumn("_base", F.expr("left(_path, length(_path) - length(_ext))"))
    names = names.withColumn("_tail", tail).withColumn("_level", level)
    names = stored(names.withColumn("_parent", F.when(F.col("_tail") != "", parent)), "names")
    busy = names.where("_n > 1")
    levels = [r[0] for r in busy.select("_level").distinct().orderBy("_level").collect()]
    if not levels:
        return df.withColumn(out, F.col(path))
    rows = df.withColumn("_row", F.struct(*df.columns)).select("_row", F.col(path).alias("_stem"), F.struct(*order).alias("_at"))
    taken = spark.createDataFrame([], "_stem string, _level int")
    done: list[DataFrame] = []
    level = levels[0]
    while True:
        here = busy.where(F.col("_level") == level).select(F.col("_path").alias("_stem")).unionByName(taken.where(F.col("_level") == level).select("_stem")).distinct()
        here = here.join(taken.select("_stem", F.lit(0).alias("_own")), "_stem", "left").select("_stem", F.coalesce("_own", F.lit(1)).alias("_own"))
        targets, taken_now = _numbered(rows, names, here, suffix)
        done.append(targets)
        taken = stored(taken.unionByName(taken_now.select("_stem", F.lit(level + 1).alias("_level"))), "taken")
        further = [r[0] for r in taken.where(F.col("_level") > level).select("_level").distinct().collect()]
        further += [x for x in levels if x > level]
        if not further:
            break
        level = min(further)
    settled = functools.reduce(DataFrame.unionByName, done)
    moved = busy.select("_path").unionByName(taken.select(F.col("_stem").alias("_path"))).distinct()
    free = df.join(moved, df[path] == moved["_path"], "left_anti").withColumn(out, F.col(path))
    return free.unionByName(settled.select("_row.*", F.col("_target").alias(out)))


def _numbered(rows: DataFrame, names: DataFrame, stems: DataFrame, suffix: str) -> tuple[DataFrame, DataFrame]:
    """(targets (_row, _target), taken (_stem)) of the rows of ``stems`` (_stem, _own: 1 if its first row has the name)."""
    kids = names.where("_parent is not null").select(F.col("_parent").alias("_stem"), F.col("_tail").cast("long").alias("_idx"), F.col("_first").alias("_at"))
    # Several natural paths can't share a stem and a number, so a number has one first row.
    kids = kids.join(stems, "_stem").withColumns({"_kind": F.lit(0), "_row": F.lit(None).cast(rows.schema["_row"].dataType)})
    mine = rows.join(stems, "_stem").withColumns({"_kind": F.lit(1), "_idx": F.lit(None).cast("long")})
    columns = ["_stem", "_own", "_kind", "_idx", "_at", "_row"]
    both = running_sums(
        mine.select(columns).unionByName(kids.select(columns)), ["_stem"], ["_at", "_kind"], {"_pos": F.lit(1), "_k": F.col("_kind")}
    )
    # Further rows are numbered from 1; the first row has the name itself, unless a stem above took it.
    both = stored(both.withColumn("_idx", F.when(F.col("_kind") == 1, F.col("_k") - F.col("_own")).otherwise(F.col("_idx"))), "numbers")
    largest = both.where("_kind = 0").groupBy("_stem").agg(F.max("_idx").alias("_most"))
    told = both.join(largest, "_stem", "left").withColumn("_most", F.coalesce("_most", F.lit(0)))
    walked = told.where("_most > 0 and (_kind = 0 or (_idx > 0 and _idx <= _most))")
    sorted_ = walked.select("_stem", "_kind", "_idx", "_pos").repartition("_stem").sortWithinPartitions("_stem", "_kind", "_idx")
    found = stored(sorted_.mapInArrow(_walk, "_stem string, _what int, _idx long, _slot long"), "walked")
    slot = found.where("_what = 0").select("_stem", "_idx", "_slot")
    passed = found.where("_what = 1").select("_stem", F.col("_slot").alias("_passed"))
    further = told.where("_kind = 1 and _idx > 0").join(slot, ["_stem", "_idx"], "left").join(passed, "_stem", "left")
    number = F.coalesce("_slot", F.col("_idx") + 1 + F.coalesce("_passed", F.lit(0)))
    ext = F.regexp_extract("_stem", r"(\.[^./]*)$", 1)
    name = F.concat(F.expr("left(_stem, length(_stem) - length(_ext))"), F.lit(suffix), number.cast("string"), F.col("_ext"))
    targets = further.withColumn("_ext", ext).select("_row", name.alias("_target"))
    first = both.where("_kind = 1 and _idx = 0").select("_row", F.col("_stem").alias("_target"))
    took = found.where("_what = 2").withColumn("_ext", ext)
    taken = took.select(F.concat(F.expr("left(_stem, length(_stem) - length(_ext))"), F.lit(suffix), F.col("_slot").cast("string"), F.col("_ext")).alias("_stem"))
    return first.unionByName(targets), taken


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of further rows, stem by stem: first come the numbers that paths have by nature, with the positions at
    which they are taken, then the further rows. Gives (stem, 0, index, number), at a stem's end (stem, 1, null, numbers
    passed) and (stem, 2, null, number) for each natural number that a further row took before."""
    stem, natural, at, passed, seen = None, [], 0, 0, False
    out: list[tuple] = []

    def end() -> None:
        if stem is not None:
            # Rows beyond the largest natural number come later than all that are seen; what is left is passed or, where
            # no row comes, untouched, and then nothing asks for it.
            out.append((stem, 1, None, passed))

    for batch in batches:
        for name, kind, idx, pos in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != stem:
                end()
                stem, natural, at, passed = name, [], 0, 0
            if kind == 0:
                natural.append((idx, pos))
                continue
            number = idx + 1 + passed
            while at < len(natural) and natural[at][0] == number:
                at += 1
                if natural[at - 1][1] > pos:
                    out.append((stem, 2, None, number))
                    break
                number, passed = number + 1, passed + 1
            out.append((stem, 0, idx, number))
        if out:
            yield _told(out)
            out = []
    end()
    if out:
        yield _told(out)


def _told(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["_stem", "_what", "_idx", "_slot"])
