"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Documents of a source are cut into blocks of equal size. With weight w (its share of the
sequence), block k of a source is released at slot floor(k / w) and due at the end of slot
ceil((k + 1) / w). One block is placed in each slot, the earliest deadline among the
released ones first; as the weights add up to one, every deadline is met, and after any
number of slots each source is less than one block away from its share.

Sources too small for a slot of the period are scheduled in two steps: together they are one
source of the period, and in its slots their blocks follow by the deadlines of their exact
weights. So every source with a weight has its slots, whatever its weight and their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.common import SharedTable, count_rows
from talus.operators.ranking import global_rank

#: Slots of a period: weights are rounded to this many parts. It bounds the tables of the
#: pattern and of the weights, so that both may be broadcast.
PERIOD = 1000
#: Documents in a block, and in a bucket of the ranking on average.
BLOCK_DOCS, BUCKET_DOCS = 16, 4096
#: Weights by default: sizes of the sources to this power, so that large sources give way.
TEMPERATURE = 0.7


def _order(id_col: str) -> Column:
    """A shuffled order that any engine can compute: the id's MD5."""
    return F.md5(F.col(id_col).cast("string"))


def tempered_weights(docs: DataFrame, source: str = "source", temperature: float = TEMPERATURE) -> DataFrame:
    """(source, weight): number of documents to the power `temperature`; weights are relative."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("source", F.pow(F.col("n").cast("double"), F.lit(temperature)).alias("weight"))


def whole_parts(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, small, parts): weights as whole parts of `period`, by largest remainders. The
    sources of less than one part are one row together, with `small` and a null source; so
    there are at most `period` rows and one."""
    total = weights.where("weight > 0").agg(F.sum("weight").alias("total"))
    share = F.col("weight") / F.col("total") * period
    # Sums and shares are rounded, so that any engine and any order of adding gives the same parts.
    named = weights.where("weight > 0").crossJoin(F.broadcast(total)).select("source", F.round(share, 6).alias("share"))  # one row
    small = F.col("share") < 1
    usable = named.groupBy(F.when(~small, F.col("source")).alias("source"), small.alias("small")).agg(F.sum("share").alias("share"))
    usable = usable.withColumn("share", F.greatest(F.round("share", 6), F.lit(1.0)))
    all_rows = Window.partitionBy()  # at most `period` rows and one
    floors = usable.select("source", "small", F.floor("share").alias("whole"), (F.col("share") - F.floor("share")).alias("rest"))
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.round("rest", 6)), "small", F.asc_nulls_first("source")))
    missing = F.lit(period) - F.sum("whole").over(all_rows)
    parts = floors.select("source", "small", "whole", place.alias("place"), missing.alias("missing"))
    return parts.select("source", "small", (F.col("whole") + (F.col("place") <= F.col("missing")).cast("long")).alias("parts")).where("parts > 0")


def pattern(parts: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, small, parts, k, slot): the earliest-deadline-first schedule of one period.
    Later periods repeat it, as all weights are whole parts of the period."""
    parts = parts if "small" in parts.columns else parts.withColumn("small", F.lit(False))
    one = parts.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("name"), "small", "source", "parts"))).alias("s"))

    def step(state: Column, slot: Column) -> Column:
        placed = state["placed"]
        # (deadline, index) of the next block of each source that is released by this slot
        due = F.transform(
            F.col("s"),
            lambda x, i: F.when(
                (placed[i] < x["parts"]) & (F.floor(placed[i] * period / x["parts"]) <= slot),
                F.struct(F.ceil((placed[i] + 1) * period / x["parts"]).alias("deadline"), i.alias("i")),
            ),
        )
        best = F.array_min(due)["i"]
        counts = F.transform(placed, lambda n, i: n + F.when(i == best, F.lit(1)).otherwise(F.lit(0)).cast("long"))
        chosen = F.struct(best.alias("i"), placed[best].alias("k"), slot.cast("int").alias("slot"))
        return F.struct(counts.alias("placed"), F.concat(state["slots"], F.array(chosen)).alias("slots"))

    start = F.struct(
        F.transform(F.col("s"), lambda x: F.lit(0).cast("long")).alias("placed"), F.array().cast("array<struct<i:int,k:bigint,slot:int>>").alias("slots")
    )
    run = F.aggregate(F.sequence(F.lit(0), F.lit(period - 1)), start, step, lambda state: state["slots"])
    slots = one.where(F.size("s") > 0).select("s", F.explode(run).alias("b"))
    return slots.select(F.col("s")[F.col("b.i")].alias("x"), "b.k", "b.slot").select("x.source", "x.small", "x.parts", "k", "slot")


def source_ranks(docs: DataFrame, source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(id, source, rank): place of each document in its source's shuffled order, from 0.

    A source of any size is ranked in buckets of bounded size: hash ranges whose number
    follows the source's size, ranked each for itself and moved by what lies before them.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source")).withColumn("h", _order("id"))
    sizes = rows.groupBy(F.col("source").alias("name")).agg(F.ceil(F.count(F.lit(1)) / BUCKET_DOCS).alias("buckets"))
    spread = rows.join(sizes, F.col("source").eqNullSafe(F.col("name"))).select("id", "source", "h", "buckets")
    part = F.conv(F.substring(F.coalesce("h", F.lit("0000000")), 1, 7), 16, 10).cast("long")
    spread = spread.select("id", "source", "h", F.floor(part * F.col("buckets") / (1 << 28)).cast("long").alias("bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select(F.col("source").alias("name"), F.col("bucket").alias("part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("source", "bucket").orderBy(F.asc_nulls_first("h"), F.asc_nulls_first("id")))
    ranked = spread.select("id", "source", "bucket", own.alias("own"))
    same = F.col("source").eqNullSafe(F.col("name")) & (F.col("bucket") == F.col("part"))
    return ranked.join(starts, same).select("id", "source", (F.col("own") - 1 + F.col("start")).alias("rank"))


def _small_slots(docs: DataFrame, weights: DataFrame, parts: DataFrame, table: DataFrame, source: str, period: int, block_docs: int) -> DataFrame:
    """(name, b, slot, release, deadline) of each block of the sources that share the row
    `small` of the pattern: its slots taken in the order of the blocks' exact deadlines. One
    deadline is that of at most one block of each source, which bounds what is ranked together."""
    total = weights.where("weight > 0").agg(F.sum("weight").alias("total"))
    shares = weights.where("weight > 0").crossJoin(F.broadcast(total)).where(F.round(F.col("weight") / F.col("total") * period, 6) < 1)  # one row
    sizes = docs.groupBy(F.col(source).alias("name")).agg(F.ceil(F.count(F.lit(1)) / block_docs).cast("long").alias("blocks"))
    blocks = sizes.join(shares, F.col("name").eqNullSafe(F.col("source"))).select("name", "weight", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"))
    due = SharedTable(blocks.withColumn("due", (F.col("b") + 1) / F.col("weight")), "small-blocks").df
    ranked = global_rank(due, [F.asc("due"), F.asc_nulls_first("name"), F.asc("b")], buckets=min(4096, 1 + count_rows(due) // 4096), name="place")
    own = F.broadcast(table.where("small").select(F.col("k"), F.col("slot").alias("at"), "parts"))
    placed = ranked.crossJoin(F.broadcast(parts.where("small").select(F.col("parts").alias("n")))).withColumn("turn", F.floor((F.col("place") - 1) / F.col("n")))  # one row
    placed = placed.join(own, F.pmod(F.col("place") - 1, F.col("n")) == F.col("k"))
    scale = F.col("total") / F.col("weight")
    return placed.select(
        "name", "b", (F.col("turn") * period + F.col("at")).cast("long").alias("slot"), F.floor(F.col("b") * scale).alias("release"), F.ceil((F.col("b") + 1) * scale).alias("deadline")
    )


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, source: str = "source", id_col: str = "doc_id", period: int = PERIOD, block_docs: int = BLOCK_DOCS
) -> DataFrame:
    """(id, source, block, slot, release, deadline, position, in_mix), a row per row of `docs`.

    slot is the block's place in the mix, position the document's. in_mix is true before the
    horizon, the slot at which the first source (or the small ones together) has no block
    left to place; up to there the mix has the target weights. The last block of a source may
    be shorter. Small sources have the release and deadline of their exact weights; in the
    slots that they share, none falls a block behind its share of them. Sources without a
    positive weight have no slot and are not in the mix. A null source is a source of its
    own; null ids and repeated rows have places of their own; an empty table gives no rows.
    """
    weights = SharedTable(tempered_weights(docs, source) if weights is None else weights, "weights").df
    parts = SharedTable(whole_parts(weights, period), "parts").df
    table = SharedTable(pattern(parts, period), "pattern").df  # `period` rows
    ranked = source_ranks(docs, source, id_col).withColumn("block", F.floor(F.col("rank") / block_docs).cast("long"))
    p = F.broadcast(parts.where("not small").select(F.col("source").alias("p_name"), "parts"))
    t = F.broadcast(table.where("not small").select(F.col("source").alias("t_name"), F.col("k").alias("t_k"), F.col("slot").alias("at")))
    named, timed = F.col("source").eqNullSafe(F.col("p_name")), F.col("source").eqNullSafe(F.col("t_name")) & (F.pmod("block", "parts") == F.col("t_k"))
    placed = ranked.join(p, named, "left").join(t, timed, "left")
    turn = F.floor(F.col("block") / F.col("parts"))
    out = placed.select(
        "id", "source", "rank", "block",
        (turn * period + F.col("at")).alias("slot"),
        F.floor(F.col("block") * period / F.col("parts")).alias("release"),
        F.ceil((F.col("block") + 1) * period / F.col("parts")).alias("deadline"),
    )
    # The horizon: the earliest slot that a source's next block after its last one would take.
    ends = docs.groupBy(F.col(source).alias("source")).agg(F.ceil(F.count(F.lit(1)) / block_docs).alias("block"))
    ends = ends.join(p, named).join(t, timed)
    horizon = ends.agg(F.min(F.floor(F.col("block") / F.col("parts")) * period + F.col("at")).alias("horizon"))
    if not parts.where("small").isEmpty():
        slots = SharedTable(_small_slots(docs, weights, parts, table, source, period, block_docs), "small-slots").df
        late = slots.select("name", "b", F.col("slot").alias("s"), F.col("release").alias("r"), F.col("deadline").alias("d"))
        joined = out.join(late, F.col("source").eqNullSafe(F.col("name")) & (F.col("block") == F.col("b")), "left")
        out = joined.select("id", "source", "rank", "block", F.coalesce("slot", "s").alias("slot"), F.coalesce("release", "r").alias("release"), F.coalesce("deadline", "d").alias("deadline"))
        after = slots.agg(F.max("slot").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 0").join(F.broadcast(table.where("small")), F.pmod("n", "parts") == F.col("k"))
        after = after.select((F.floor(F.col("n") / F.col("parts")) * period + F.col("slot")).cast("long").alias("horizon"))
        horizon = horizon.unionByName(after).agg(F.min("horizon").alias("horizon"))
    marked = out.crossJoin(F.broadcast(horizon))  # one row
    position = F.col("slot") * block_docs + F.pmod("rank", F.lit(block_docs))
    return marked.select("id", "source", "block", "slot", "release", "deadline", position.alias("position"), F.coalesce(F.col("slot") < F.col("horizon"), F.lit(False)).alias("in_mix"))


def mix_order(docs: DataFrame, source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(id, slot, position), a row per row of `docs`: the places of mix_sources() at the
    weights by default, beyond its horizon as well. Every source has its places, so none ends
    the mix and none is left out, whatever their number."""
    return mix_sources(docs, source=source, id_col=id_col).select("id", "slot", "position")
