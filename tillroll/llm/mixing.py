"""Mixing sources to target weights with hash-threshold histograms.

Every source gets a budget of words.  Whole rounds of a source are taken by
all its documents; the rest of the budget goes to the documents whose hash is
below the source's threshold, which take one round more.  The threshold is
found without sorting documents: sizes are added up by source and leading
hash bits, the bucket in which the budget runs out is found, and only that
bucket is counted again by the next bits.  Budgets are nested: a larger budget
keeps all documents of a smaller one.

The hash is of id and text, so that rows share one only if both are repeated.
Where the threshold falls between such rows, as many of them as come nearest
to the budget take one round more.

Edge cases: a null text has size 0 and hashes like an empty one; a null source
is a source of its own and comes last; a null id hashes like any value; an empty
table gives an empty result; columns named like the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.llm.batches import aside
from tillroll.operators.joins import join_lookup
from tillroll.session import stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all words
CAP = 2  # times the source's words
HASH_BITS = 60
LEVEL_BITS = 12
TIE_BLOCK_BITS = 16  # rows on the threshold are numbered in blocks of at most so many bits
WORD = r"[^\x20\x09-\x0D]+"


def document_hash(key: Column, text: Column) -> Column:
    """60 bits that decide in which order a source's documents are taken."""
    both = F.concat(
        F.coalesce(key.cast("string"), F.lit("null")), F.lit(" "), F.coalesce(text, F.lit(""))
    )
    return F.conv(F.substring(F.md5(both), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """Word budget of each source: (source, source_size) becomes + target.

    Sources in code point order, null last, take the weights in turn.  A
    source whose share by weight exceeds ``cap`` times its size stops there
    and the excess goes to the others by weight; that settles at one level
    ``words per weight``, found from the sources in the order in which they
    reach their cap.  Works on one row per source.
    """
    one = F.lit(1)
    place = Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(
        F.array(*[F.lit(int(w)) for w in weights]),
        (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    weighted = sizes.withColumn("_w", turn).withColumn("_cap", F.col("source_size") * F.lit(cap))
    filling = Window.partitionBy(one).orderBy(
        F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()
    )
    everyone = Window.partitionBy(one)
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    later = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = weighted.select(
        "*",
        (F.sum("source_size").over(everyone) * F.lit(share)).alias("_all"),
        F.coalesce(F.sum("_cap").over(earlier), F.lit(0)).alias("_full"),
        F.sum("_w").over(later).alias("_left"),
    ).withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_left"))
    # The level holds from the first source that it doesn't bring to its cap.
    stands = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))
    level = F.min_by(stands, F.when(stands.isNotNull(), F.col("_cap") / F.col("_w"))).over(everyone)
    target = F.least(F.col("_cap").cast("double"), F.coalesce(level * F.col("_w"), F.col("_cap")))
    return levels.select("source", "source_size", target.cast("double").alias("target"))


def _thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, whole, below, copies): documents with a hash under ``below`` take one round more.

    ``budgets`` has source, whole rounds and the words left over.  Each level
    adds up the sizes in what is left of the source's hash range by the next
    bits and keeps the bucket in which the words run out.  At the last level a
    bucket is a single hash value, and its rows are copies of one document; of
    those, ``copies`` take one round more, as many as come nearest.
    """
    found = budgets.select(
        "source", "whole", F.col("left").cast("double").alias("left"), F.lit(0).cast("long").alias("prefix")
    )
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        at = F.shiftright(F.col("hash"), shift)
        inside = docs.withColumn("_prefix", F.shiftright(at, LEVEL_BITS)).join(
            found.select(
                F.col("source").alias("_s"), F.col("prefix").alias("_p"), "whole", "left"
            ),
            F.expr("source <=> _s and _prefix = _p"),
        )
        histogram = inside.groupBy("source", "whole", "left", at.alias("bucket")).agg(
            F.sum("size").alias("words"), F.count("*").alias("rows")
        )
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(
            Window.unboundedPreceding, -1
        )
        histogram = histogram.withColumn("_before", F.coalesce(F.sum("words").over(run), F.lit(0)))
        # The boundary bucket: the last that begins within the words left.
        boundary = histogram.where(F.col("_before") <= F.col("left")).groupBy(
            "source", "whole", "left"
        ).agg(F.max_by(F.struct("bucket", "_before", "words", "rows"), "bucket").alias("_b"))
        found = boundary.select(
            "source",
            "whole",
            (F.col("left") - F.col("_b._before")).alias("left"),
            F.col("_b.bucket").alias("prefix"),
            F.col("_b.words").alias("words"),
            F.col("_b.rows").alias("rows"),
        )
    nearest = F.floor(F.col("left") * F.col("rows") / F.nullif(F.col("words"), F.lit(0)) + 0.5)
    copies = F.least(F.coalesce(nearest, F.lit(0)), F.col("rows"))
    every = copies == F.col("rows")
    return found.select(
        "source",
        "whole",
        (F.col("prefix") + F.when(every, 1).otherwise(0)).alias("below"),
        F.when(every, 0).otherwise(copies).cast("long").alias("copies"),
    )


def measured(docs: DataFrame) -> DataFrame:
    """Id, source, hash and size in words of each document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    return docs.select(
        "doc_id",
        "source",
        document_hash(F.col("doc_id"), F.col("text")).alias("hash"),
        size.cast("long").alias("size"),
    )


def source_plan(
    sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """(source, source_size, target, whole, below, copies): what the mix takes of each source.

    ``sized`` has source, hash and size and should be a stored table, as it is
    read once per level.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(by_source, weights, share, cap)
    full = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    budgets = targets.withColumn("whole", full.cast("long")).withColumn(
        "left", F.col("target") - F.col("whole") * F.col("source_size")
    )
    cut = _thresholds(sized, budgets).select(F.col("source").alias("_s"), "below", "copies")
    return budgets.join(cut, F.expr("source <=> _s"), "left").select(
        "source", "source_size", "target", "whole", "below", "copies"
    )


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("null"))


def with_rounds(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` with source_size, target and ``rounds``, how often each is taken.

    ``docs`` has source and hash.  The plan has one row per source and should
    be a stored table; it is broadcast if its measured size allows, otherwise
    joined with hot sources spread out.
    """
    result = [*docs.columns, "source_size", "target", "rounds"]
    lookup = plan.select(
        _source_key("source").alias("_key"), "source_size", "target", "whole", "below", "copies"
    )
    joined = join_lookup(docs.withColumn("_key", _source_key("source")), lookup, "_key")
    more = F.when(F.col("hash") < F.col("below"), 1).otherwise(0)
    joined = joined.withColumn("rounds", F.col("whole") + more)
    if plan.where("copies > 0").isEmpty():
        return joined.select(*result)
    on_threshold = F.coalesce((F.col("hash") == F.col("below")) & (F.col("copies") > 0), F.lit(False))
    copy = _numbered(joined.where(on_threshold))
    chosen = copy.withColumn("rounds", F.col("rounds") + F.when(F.expr("_copy <= copies"), 1).otherwise(0))
    return joined.where(~on_threshold).select(*result).unionByName(chosen.select(*result))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_copy``, their number from 1 among those of their ``_key``.

    Each row's place is written with it, so numbers stay if tasks run again.
    Rows are numbered in blocks of places, and the blocks are added up: no task
    holds all copies of a document.
    """
    placed = stage(rows.withColumn("_place", F.monotonically_increasing_id()), "copies")
    placed = placed.withColumn("_block", F.shiftright("_place", TIE_BLOCK_BITS))
    earlier = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_key", "_block")
        .agg(F.count("*").alias("_n"))
        .select("_key", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_key", "_block").orderBy("_place")
    numbered = placed.withColumn("_copy", F.row_number().over(inside))
    joined = join_lookup(numbered, stage(starts, "copy-blocks"), ["_key", "_block"])
    return joined.withColumn("_copy", F.col("_start") + F.col("_copy"))


def mixed(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it, with the same columns."""
    used, back = aside(docs, ("doc_id", "source", "text"))
    plan = stage(source_plan(stage(measured(used), "sizes")), "mix")
    hashed = used.withColumn("hash", document_hash(F.col("doc_id"), F.col("text")))
    taken = with_rounds(hashed, plan).where("rounds > 0")
    return back(taken.withColumn("_round", F.explode(F.sequence(F.lit(1), F.col("rounds")))))
