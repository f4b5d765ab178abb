"""Visual copies inside a group: pair test, transitive groups, keeper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepstone.config import NO_TIME, Curation
from keepstone.functions.scalars import hash_halves
from keepstone.operators.graph import connected_components
from keepstone.sources.shared import stored


def is_copy(a: str, b: str, cfg: Curation) -> Column:
    """The same picture saved twice: close in time, hash and exposure; another size needs the same shape, the same
    size needs nearly the same sharpness."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    apart = F.abs(F.unix_micros(x("taken_at").cast("timestamp")) - F.unix_micros(y("taken_at").cast("timestamp")))
    bits = F.bit_count(x("h.hi").bitwiseXOR(y("h.hi"))) + F.bit_count(x("h.lo").bitwiseXOR(y("h.lo")))
    same_size = (x("width") == y("width")) & (x("height") == y("height"))
    shape = F.abs(x("width") / x("height") - y("width") / y("height")) < 0.01
    sharp = F.least(x("sharpness"), y("sharpness")) >= 0.9 * F.greatest(x("sharpness"), y("sharpness"))
    return (
        (apart <= int(cfg.copy_gap_seconds * 1_000_000))
        & (bits <= cfg.copy_bits)
        & (F.abs(x("exposure") - y("exposure")) <= 0.05)
        & F.when(same_size, sharp).otherwise(shape)
    )


def copy_pairs(records: DataFrame, cfg: Curation) -> DataFrame:
    """(moment_id, a, b) of copies within a group.

    Rows meet only in their own or the next slot of time as wide as the allowed gap, so a large group is never paired
    with itself.
    """
    timed = records.where(~F.col("date_source").isin(*NO_TIME))
    width = max(1, int(cfg.copy_gap_seconds * 1_000_000))
    base = timed.withColumns(
        {"h": hash_halves(F.col("phash")), "slot": F.floor(F.unix_micros(F.col("taken_at").cast("timestamp")) / width)}
    )
    left = base.select("*", F.explode(F.array(F.col("slot"), F.col("slot") + 1)).alias("meet")).alias("l")
    right = base.withColumn("meet", F.col("slot")).alias("r")
    on = (F.col("l.moment_id") == F.col("r.moment_id")) & (F.col("l.meet") == F.col("r.meet"))
    earlier = (F.col("l.slot") < F.col("r.slot")) | (F.col("l.sha256") < F.col("r.sha256"))
    return left.join(right, on & earlier & (F.col("l.sha256") != F.col("r.sha256")) & is_copy("l", "r", cfg)).select(
        F.col("l.moment_id").alias("moment_id"),
        F.least("l.sha256", "r.sha256").alias("a"),
        F.greatest("l.sha256", "r.sha256").alias("b"),
    )


#: Width of a bin of logarithms of sharpness, a little less than that of the allowed ratio of 0.9, and of a bin of exposures.
_SHARP, _EXPOSED, _SURE = 0.105, 0.05, 1e-9


def _told(records: DataFrame, cfg: Curation) -> DataFrame:
    """Rows that can be copies, with the cell in which they lie: rows of one cell are all copies of one another.

    A row whose sharpness can't be compared is a cell of its own; rows that never pass the test are left out.
    """
    timed = records.where(~F.col("date_source").isin(*NO_TIME)).withColumns({"_h": hash_halves(F.col("phash")), "_t": F.unix_micros(F.col("taken_at").cast("timestamp"))})
    sharp, exposed = F.col("sharpness").cast("double"), F.col("exposure").cast("double")
    steps = F.when(F.isnan(sharp), 1 << 40).when(sharp == float("inf"), 1 << 41).when(sharp > 0, F.floor(F.log(sharp) / _SHARP)).when(sharp == 0, -(1 << 40))
    told = timed.withColumns(
        {
            "_x": F.call_function("shiftleft", F.col("_h.hi"), F.lit(32)).bitwiseOR(F.col("_h.lo")),
            "_slot": F.floor(F.col("_t") / max(1, int(cfg.copy_gap_seconds * 1_000_000))),
            "_e": exposed,
            "_s": sharp,
            "_light": F.floor(F.when(F.abs(exposed) < 1e6, exposed) / (_EXPOSED * (1 - _SURE))),
            "_sharp": F.coalesce(steps, F.lit(0)).cast("long"),
            "_lone": F.when(steps.isNull(), F.col("sha256")).otherwise(""),
        }
    )
    return told.dropna(subset=["moment_id", "_x", "_slot", "_light", "width", "height"])


_PLACE = ["moment_id", "_x", "_slot", "_light"]
_BLOCK = [*_PLACE, "width", "height"]
_CELL = [*_BLOCK, "_sharp", "_lone"]


def _cells(told: DataFrame) -> DataFrame:
    """Points (cell, exposure, sharpness) with their first and last time, and the node of which they are part: their cell,
    or, where another size of the same shape lies in the same place, all of their size there, as each of those is a copy
    of each of the others. A node is named after its least row; ``_many``: it has several."""
    points = told.groupBy(*_CELL, "_e", "_s").agg(F.min("_t").alias("_from"), F.max("_t").alias("_to"), F.min("sha256").alias("_least"), F.count("*").alias("_n"))
    ratio = F.try_divide(F.col("width").cast("double"), F.col("height").cast("double"))
    by = Window.partitionBy(*_PLACE).orderBy("_ratio", "width", "height")
    sizes = told.select(*_BLOCK).distinct().withColumn("_ratio", ratio)
    near = (F.col("_ratio") - F.lag("_ratio").over(by) < 0.01) | (F.lead("_ratio").over(by) - F.col("_ratio") < 0.01)
    sizes = sizes.withColumn("_merged", F.coalesce(near, F.lit(False))).where("_merged").drop("_ratio")
    block, cell = Window.partitionBy(*_BLOCK), Window.partitionBy(*_CELL)
    # A sharpness that isn't known is beside any that isn't negative, so those of a block are one node as well.
    blank, known = F.max(F.col("_s").isNull()).over(block), F.max(F.coalesce(F.col("_s") >= 0, F.lit(False))).over(block)
    whole = F.coalesce("_merged", F.lit(False)) | (blank & known & F.coalesce(F.col("_s") >= 0, F.lit(True)))
    met = points.join(sizes, _BLOCK, "left").withColumn("_whole", whole)
    either = lambda f, c: F.when(F.col("_whole"), f(F.when(F.col("_whole"), F.col(c))).over(block)).otherwise(f(c).over(cell))
    return met.withColumns({"_node": either(F.min, "_least"), "_many": either(F.sum, "_n") > 1}).drop("_least", "_n", "_merged", "_whole")


def _near_hashes(points: DataFrame, bits: int) -> DataFrame:
    """(moment_id, _x, _y), _x < _y: different hashes of a group with so many differing bits at most. Of bits + 1 pieces
    one is the same in both, so hashes only meet by a piece."""
    keys = points.select("moment_id", "_x").distinct()
    ends = [64 * j // (bits + 1) for j in range(bits + 2)]
    piece = lambda j: F.struct(F.lit(j).alias("j"), F.call_function("shiftrightunsigned", F.col("_x"), F.lit(ends[j])).bitwiseAND(F.lit((1 << (ends[j + 1] - ends[j])) - 1)).alias("v"))
    cut = keys.withColumn("_p", F.explode(F.array(*[piece(j) for j in range(bits + 1)]))).select("moment_id", "_x", "_p.j", "_p.v")
    pairs = cut.join(cut.withColumnRenamed("_x", "_y"), ["moment_id", "j", "v"]).where("_x < _y")
    return pairs.where(F.bit_count(F.col("_x").bitwiseXOR(F.col("_y"))) <= bits).select("moment_id", "_x", "_y").distinct()


def _links(points: DataFrame, cfg: Curation) -> DataFrame:
    """(a, b) of nodes of which a row of one is a copy of a row of the other: a link for each two nodes, not for each pair
    of rows. Points ask the places within reach of them; pairs of points are only ever reduced to nodes."""
    wide, reach = _EXPOSED * (1 - _SURE), _EXPOSED * (1 + _SURE)
    low, high = F.floor((F.col("_e") - reach) / wide), F.floor((F.col("_e") + reach) / wide)
    at = lambda step, first: F.transform(F.sequence(first, high), lambda c: F.struct((F.col("_slot") + step).alias("slot"), c.alias("light")))
    own = points.withColumn("_y", F.col("_x")).withColumn("_ask", F.explode(F.concat(at(0, F.col("_light")), at(1, low))))
    asked = own
    if cfg.copy_bits > 0 and cfg.copy_bits < 64:
        other = points.join(_near_hashes(points, cfg.copy_bits), ["moment_id", "_x"])
        asked = own.unionByName(other.withColumn("_ask", F.explode(F.concat(at(-1, low), at(0, low), at(1, low)))))
    told = ["width", "height", "_e", "_s", "_from", "_to", "_node"]
    left = asked.select("moment_id", F.col("_y").alias("_x"), F.col("_ask.slot").alias("_slot"), F.col("_ask.light").alias("_light"), *[F.col(c).alias(f"l{c}") for c in told])
    right = points.select(*_PLACE, *[F.col(c).alias(f"r{c}") for c in told])
    l, r = (lambda c: F.col(f"l{c}")), (lambda c: F.col(f"r{c}"))  # noqa: E741
    apart = F.greatest(r("_from") - l("_to"), l("_from") - r("_to"))
    same_size = (l("width") == r("width")) & (l("height") == r("height"))
    ratio = lambda x: F.try_divide(x("width").cast("double"), x("height").cast("double"))
    sharp = F.least(l("_s"), r("_s")) >= 0.9 * F.greatest(l("_s"), r("_s"))
    test = (
        (l("_node") != r("_node"))
        & (apart <= int(cfg.copy_gap_seconds * 1_000_000))
        & (F.abs(l("_e") - r("_e")) <= _EXPOSED)
        & F.when(same_size, sharp).otherwise(F.abs(ratio(l) - ratio(r)) < 0.01)
    )
    met = left.join(right, _PLACE).where(test)
    return met.select(F.least("l_node", "r_node").alias("a"), F.greatest("l_node", "r_node").alias("b")).distinct()


def mark_copies(records: DataFrame, cfg: Curation) -> DataFrame:
    """(sha256, duplicate_of): every copy but its group's keeper points at the keeper; all others have null."""
    return records.select("sha256").join(copies_of(records, cfg), "sha256", "left")


def copies_of(records: DataFrame, cfg: Curation) -> DataFrame:
    """(sha256, duplicate_of) of the copies alone.

    Keeper: most pixels, then sharpest, then largest file, then earliest, then least sha256. ``size`` may be null. Rows
    that lie so close together that all are copies of one another are one node; only nodes are linked, so neither pairs
    of rows nor their number are ever written, however many copies a group has.
    """
    told = _told(records, cfg)
    points = stored(_cells(told), "points")
    groups = connected_components(_links(points, cfg))
    cells = points.select(*_CELL, "_node", "_many").distinct().join(groups, points["_node"] == groups["node"], "left")
    cells = cells.withColumn("component", F.coalesce("component", F.when(F.col("_many"), F.col("_node")))).where("component is not null")
    size, pixels = F.coalesce("size", F.lit(0)), F.col("width").cast("long") * F.col("height")
    sharpest = F.struct(F.col("_s").isNull(), ~F.isnan("_s"), -F.col("_s"))
    rank = F.struct((-pixels).alias("p"), sharpest.alias("s"), (-size).alias("z"), F.col("_t").alias("t"), "sha256")
    members = stored(told.select(*_CELL, "sha256", rank.alias("_rank")).join(cells.select(*_CELL, "component"), _CELL).select("sha256", "component", "_rank"), "members")
    keepers = members.groupBy("component").agg(F.min("_rank").alias("_first")).select("component", F.col("_first.sha256").alias("duplicate_of"))
    return members.join(keepers, "component").where("sha256 != duplicate_of").select("sha256", "duplicate_of")
