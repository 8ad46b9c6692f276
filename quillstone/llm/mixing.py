"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

The rate of a document (its expected number of copies) stays as close to 1 as it can, in relative entropy, while the
words of each source meet that source's target and no rate exceeds ``most``. The solution is an exponential tilt,
``rate = min(most, exp(multiplier(source) * size / mean size of the source))``; the multipliers solve the convex dual
by Newton's method, each step kept inside a shrinking bracket. Every step is one aggregation over the histogram
(source, size, documents), which no hot source and no group of copies makes larger.

Rates become copies without chance: along the sizes of a source the rates are summed and the whole part of the sum is
handed out, so a source misses its target by less than its longest document. Cells of the histogram that hold many
documents are cut into bounded parts by a hash of the document id. All sums are whole numbers (rates in billionths,
sizes in words), so reruns agree.

Defined results: null texts and texts without words have size 0 and take nothing; a null source is the last source;
repeated rows are documents of their own; equal ids in a cell are ordered arbitrarily, which only exchanges equal
rows; an empty table gives an empty result; with no word at all every target is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.operators.ranking import rank_in_group
from quillstone.sources.storage import stored

WORD = r"[^\x20\x09-\x0D]+"
UNIT = 1_000_000_000  #: parts of a rate


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A string that is never null and sorts like the source by code point, null last."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size), source as a key.

    Weights repeat along the sources. A source stops at ``most`` times its size; what it leaves is shared again by
    weight among the others until none is above. Each round is one aggregation.
    """
    ranked = rank_in_group(sizes, [], ["source"], "place")
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = stored(
        ranked.select("source", "source_size", share.alias("weight"), (F.col("source_size") * float(most)).alias("top")), "mix-sources"
    )
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    capped = F.lit(False)
    level, seen = 0.0, -1
    while True:
        used, weight, count = table.agg(
            F.coalesce(F.sum(F.when(capped, F.col("top"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(capped, 1)), F.lit(0)),
        ).first()
        if count == seen or not weight:
            break
        seen, level = count, (total - used) / weight
        capped = F.col("weight") * F.lit(level) > F.col("top")
    return table.select("source", "source_size", F.when(capped, F.col("top")).otherwise(F.col("weight") * level).alias("target"))


def _top(most: int) -> float:
    """An exponent beyond which every rate is ``most``."""
    return max(2.0, math.log(most) + 1.0)


def _rate(multiplier: Column, size: Column, mean: Column, most: int) -> Column:
    """Rate in whole billionths; the exponent is held so that no value overflows."""
    tilt = F.exp(F.least(multiplier * size / mean, F.lit(_top(most))))
    return F.round(F.least(F.lit(float(most)), tilt) * UNIT).cast("long")


def tilts(cells: DataFrame, targets: DataFrame, most: int = 3, rounds: int = 40, within: float = 1e-7) -> DataFrame:
    """(source, multiplier, mean) that meet the targets; ``cells`` has (source, size, n) with size above 0.

    Targets that are not met after the last round are an error. A target counts as met ``within`` its share, or as close as
    rates in billionths can tell.
    """
    shape = cells.groupBy("source").agg(
        (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"), F.min("size").alias("least")
    )
    first = shape.join(targets, "source").withColumn("z", F.col("least") / F.col("mean"))
    state = stored(
        first.select(
            "source",
            "mean",
            "target",
            "source_size",
            F.lit(0.0).alias("multiplier"),
            F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size")) / F.col("z")).alias("low"),
            (F.lit(max(1.1, math.log(most) + 0.1)) / F.col("z")).alias("high"),  # above ln(most) / z, where every rate is ``most``
            F.lit(1.0).alias("miss"),
        ),
        "mix-state",
    )
    for _ in range(rounds):
        at = cells.join(state, "source").withColumn("rate", _rate(F.col("multiplier"), F.col("size"), F.col("mean"), most))
        words = (F.col("n") * F.col("size")).cast("decimal(38,0)") * F.col("rate").cast("decimal(20,0)")
        bends = F.when(F.col("rate") < most * UNIT, F.round(words.cast("double") * F.col("size") / F.col("mean") / UNIT).cast("decimal(38,0)"))
        sums = at.groupBy("source").agg(F.sum(words).cast("double").alias("words"), F.sum(bends).cast("double").alias("slope"))
        now = state.join(sums, "source").withColumn("gap", F.col("words") / UNIT - F.col("target"))
        low = F.when(F.col("gap") < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(F.col("gap") > 0, F.col("multiplier")).otherwise(F.col("high"))
        bracketed = now.withColumns({"low": low, "high": high, "step": F.col("multiplier") - F.col("gap") / F.nullif("slope", F.lit(0.0))})
        inside = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        near = F.abs("gap") <= F.greatest(within * F.greatest("target", F.lit(1.0)), F.col("source_size") / UNIT)
        moved = F.when(near, F.col("multiplier")).when(inside, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2)
        state = stored(
            bracketed.select(
                "source", "mean", "target", "source_size", F.round(moved, 12).alias("multiplier"), "low", "high",
                F.when(near, 0.0).otherwise(F.abs("gap")).alias("miss"),
            ),
            "mix-state",
        )
        if not (miss := state.agg(F.max("miss")).first()[0]):
            break
    else:
        raise RuntimeError(f"a source misses its target by {miss} words after {rounds} rounds")
    return state.select("source", "mean", "multiplier")


def _closer(dealt: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """One copy more or less in the cell of each source whose size is closest to what the source misses."""
    sums = dealt.groupBy("source").agg(F.sum(F.col("dealt") * F.col("size")).alias("words"))
    misses = targets.join(sums, "source").select("source", (F.col("target") - F.col("words")).alias("miss"))
    step = F.when(F.col("miss") > 0, 1).otherwise(-1)
    able = (F.col("dealt") + step).between(0, F.col("n") * most) & (F.col("size") > 0) & (F.col("size") < 2 * F.abs("miss"))
    choice = dealt.join(misses, "source").where(able).groupBy("source").agg(
        F.min(F.struct(F.abs(F.col("size") - F.abs("miss")).alias("off"), "size", "part", step.alias("step"))).alias("c")
    ).select("source", "c.size", "c.part", "c.step")
    return dealt.join(choice, ["source", "size", "part"], "left").withColumn(
        "dealt", F.col("dealt") + F.coalesce("step", F.lit(0))
    ).drop("step")


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    part: int = 50_000,
    closing: int = 3,
) -> DataFrame:
    """key, size, source, source_size, target, rate, copies, taken of every document.

    ``part`` bounds the documents that are numbered together; ``closing`` times one copy of each source is added or
    taken away if that brings the source closer to its target.
    """
    sized = stored(docs.select(F.col(key).alias("key"), source_key(F.col(source)).alias("source"), word_count(F.col(text)).alias("size")), "mix-sizes")
    cells = stored(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-cells")
    targets = stored(
        source_targets(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, most), "mix-targets"
    )
    tilted = tilts(cells.where("size > 0"), targets, most)
    rates = targets.join(tilted, "source", "left")
    full = F.col("target") >= F.col("source_size") * float(most)
    rate = F.when(F.col("size") == 0, 0).when(full, most * UNIT).otherwise(_rate(F.col("multiplier"), F.col("size"), F.col("mean"), most))
    priced = cells.join(rates, "source").select(
        "source", "size", "source_size", "target", rate.alias("rate"), F.ceil(F.col("n") / part).alias("parts")
    )
    placed = stored(
        sized.join(priced, ["source", "size"]).select(
            "key", "source", "size", "source_size", "target", "rate", F.pmod(F.xxhash64("key"), "parts").alias("part")
        ),
        "mix-placed",
    )
    parts = placed.groupBy("source", "size", "part").agg(F.count("*").alias("n"), F.first("rate").alias("rate"))
    along = W.partitionBy("source").orderBy("size", "part").rowsBetween(W.unboundedPreceding, 0)
    reached = F.sum((F.col("n") * F.col("rate")).cast("decimal(38,0)")).over(along)
    whole = lambda x: F.floor((x + UNIT // 2) / UNIT).cast("long")
    dealt = stored(
        parts.select(
            "source", "size", "part", "n", (whole(reached) - whole(reached - F.col("n") * F.col("rate"))).alias("dealt")
        ),
        "mix-dealt",
    )
    for _ in range(closing):
        dealt = stored(_closer(dealt, targets, most), "mix-dealt")
    one = F.row_number().over(W.partitionBy("source", "size", "part").orderBy(F.xxhash64("key", F.lit(1)), "key"))
    numbered = placed.withColumn("place", one)
    copies = (F.floor(F.col("dealt") / F.col("n")) + F.when(F.col("place") <= F.col("dealt") % F.col("n"), 1).otherwise(0)).cast("long")
    named = F.when(F.startswith("source", F.lit("=")), F.expr("substring(source, 2)"))
    return numbered.join(dealt, ["source", "size", "part"]).select(
        F.col("key").alias(key), "size", named.alias("source"), "source_size", "target",
        (F.col("rate") / UNIT).alias("rate"), copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )
