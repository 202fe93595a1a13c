"""Quality classifier: interpolated modified Kneser-Ney model over characters.

A model of five characters is trained on the trusted texts (labelled good and
not toxic).  A character below U+0800 is a symbol of its own, others are
folded into 2048 classes, so an n-gram is five symbols of 12 bits in a long:
its context and its suffix are a shift and a mask.  One pass over all
documents lists the n-grams that occur and how often they do in the trusted
texts.  Counts of contexts, continuation counts and the discounts of all
orders come from that table by grouping, and joins by n-gram and by context,
spread over the cluster, give each n-gram its log probability.  A second pass
adds these up: each document's perplexity is that of its whole text.

The table of log probabilities grows with the corpus, so it is cut by hash
into shards of at most ``SHARD_GRAMS`` entries.  One shard is in memory at a
time; with several, each shard scores all documents and the parts are added.

Part of the trusted texts, chosen by a hash of the text, is kept out of the
training.  Their perplexities, at the quantile ``QUANTILE`` and by language,
are the thresholds; a language with fewer than ``LEAST_HELD_OUT`` of them
uses the quantile over all languages, and one without any their mean as well.
Short texts are judged with as many
characters of the held-out mean of their language added as ``PRIOR_CHARS``
says, since a few characters say little.

Edge cases: null and empty texts have no perplexity and are kept; a null
language is a language of its own; a document with contradicting labels is
not trusted; without trusted texts, or without held-out ones, all documents
are kept; repeated rows are scored alike; extra columns of ``docs`` stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from tillroll.llm.batches import (
    aside,
    freed_when_left,
    row_chunks,
    share,
    slices,
    text_bytes,
)
from tillroll.operators.joins import join_lookup
from tillroll.session import stage

ORDER = 5
SYMBOL_BITS = 12
EXACT_SYMBOLS = 1 << 11
HELD_OUT_OF = 5  # one trusted text in so many is held out
QUANTILE = 0.98
LEAST_HELD_OUT = 50
PRIOR_CHARS = 60
SHARD_GRAMS = 1 << 21
MERGE_GRAMS = 1 << 20
# Text that is turned into n-grams at once: some 60 bytes a character while it is.
GRAM_BYTES = 1 << 19
BIN = 1000  # bins of the quantile histogram per nat


def gram_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end at each character of the texts, and characters per text.

    Each text is preceded by ``ORDER - 1`` boundary symbols, 0.
    """
    starts = (data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(starts)])
    ends = before[offsets]
    lengths = np.diff(ends)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    symbols = np.where(
        points < EXACT_SYMBOLS, np.maximum(points, 1), EXACT_SYMBOLS | (points * 2654435761 >> 16) & 0x7FF
    ).astype(np.uint64)
    pad = ORDER - 1
    at = np.arange(len(points)) + pad * np.repeat(np.arange(1, len(lengths) + 1), lengths)
    padded = np.zeros(len(points) + pad * len(lengths), np.uint64)
    padded[at] = symbols
    grams = padded[at]
    for back in range(1, ORDER):
        grams |= padded[at - back] << np.uint64(SYMBOL_BITS * back)
    return grams, lengths


def _merge(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_grams, all_counts = np.concatenate(grams), np.concatenate(counts)
    order = np.argsort(all_grams, kind="stable")
    all_grams, all_counts = all_grams[order], all_counts[order]
    first = np.flatnonzero(np.concatenate([[True], all_grams[1:] != all_grams[:-1]]))
    return all_grams[first], np.add.reduceat(all_counts, first)


def _sorted_counts(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams = np.sort(grams)
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.diff(np.append(first, len(grams)))


def _count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams of a partition, and their counts in texts with ``train``."""
    kept: tuple[list, list] = ([], [])
    size = 0

    def rows() -> pa.RecordBatch:
        grams, counts = _merge(*kept)
        return pa.RecordBatch.from_arrays(
            [pa.array(grams.astype(np.int64)), pa.array(counts.astype(np.int64))], ["gram", "n"]
        )

    for batch in batches:
        for part in slices(batch, "text", GRAM_BYTES):
            train = np.asarray(part.column("train").fill_null(False).to_numpy(zero_copy_only=False), bool)
            grams, lengths = gram_ids(*text_bytes(part.column("text")))
            if not len(grams):
                continue
            in_train = np.repeat(train, lengths)
            for chosen, weight in ((in_train, 1), (~in_train, 0)):
                if chosen.any():
                    distinct, counts = _sorted_counts(grams[chosen])
                    kept[0].append(distinct)
                    kept[1].append(counts * weight)
                    size += len(distinct)
            if size > MERGE_GRAMS:
                merged = _merge(*kept)
                kept = ([merged[0]], [merged[1]])
                size = len(merged[0])
                if size > MERGE_GRAMS // 2:
                    yield rows()
                    kept, size = ([], []), 0
    if size:
        yield rows()
    del kept
    pa.default_memory_pool().release_unused()


def gram_table(docs: DataFrame) -> DataFrame:
    """(gram, n): every n-gram of ``docs`` with its count in the texts with ``train``."""
    pairs = docs.select("text", "train").mapInArrow(_count_grams, "gram long, n long")
    return pairs.groupBy("gram").agg(F.sum("n").alias("n"))


def _suffix(gram: str, order: int) -> Column:
    return F.col(gram).bitwiseAND(F.lit((1 << SYMBOL_BITS * order) - 1))


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts for counts of 1, 2 and 3 or more, from the counts of counts."""
    n = counts.agg(*[F.count(F.when(F.col("c") == i, 1)) for i in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (max(x, 1) for x in n)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    # Counts of counts of tiny corpora may give values out of range.
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


def log_probabilities(grams: DataFrame) -> DataFrame:
    """(gram, logp) for every n-gram of ``grams``, from those with a count."""
    counts = {ORDER: grams.where("n > 0").select("gram", F.col("n").alias("c"))}
    for order in range(ORDER - 1, 0, -1):
        longer = counts[order + 1]
        lower = longer.groupBy(_suffix("gram", order).alias("gram")).agg(F.count("*").alias("c"))
        counts[order] = stage(lower, f"kn-{order}")
    below: DataFrame | None = None
    for order in range(1, ORDER + 1):
        asked = grams.select(_suffix("gram", order).alias("gram"))
        asked = asked.distinct() if order < ORDER else asked
        have = counts[order]
        d1, d2, d3 = _discounts(have)
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        contexts = have.groupBy(F.shiftright("gram", SYMBOL_BITS).alias("context")).agg(
            F.sum("c").alias("total"),
            (
                F.count(F.when(F.col("c") == 1, 1)) * F.lit(d1)
                + F.count(F.when(F.col("c") == 2, 1)) * F.lit(d2)
                + F.count(F.when(F.col("c") >= 3, 1)) * F.lit(d3)
            ).alias("freed"),
        )
        joined = asked.join(have, "gram", "left").withColumn(
            "context", F.shiftright("gram", SYMBOL_BITS)
        )
        joined = joined.join(contexts, "context", "left")
        if below is None:
            lower_p = F.lit(1.0 / (1 << SYMBOL_BITS))
        else:
            joined = joined.withColumn("suffix", _suffix("gram", order - 1)).join(below, "suffix")
            lower_p = F.col("lower_p")
        own = F.greatest(F.col("c") - discount, F.lit(0.0))
        own = F.coalesce(own, F.lit(0.0))
        p = F.when(F.col("total").isNull(), lower_p).otherwise(
            (own + F.col("freed") * lower_p) / F.col("total")
        )
        result = joined.select("gram", p.alias("p"))
        below = stage(result, f"kn-p{order}").select(
            F.col("gram").alias("suffix"), F.col("p").alias("lower_p")
        )
    return below.select(F.col("suffix").alias("gram"), F.ln("lower_p").alias("logp"))


class GramScores:
    """Open-addressing table from n-gram to log probability, looked up by array."""

    def __init__(self, grams: np.ndarray, logp: np.ndarray) -> None:
        self.bits = max(int(len(grams) * 2 - 1).bit_length(), 4)
        size = 1 << self.bits
        self.keys = np.zeros(size, np.uint64)  # no n-gram is 0: its last symbol isn't
        self.values = np.zeros(size, np.float32)
        slots, left = self._slot(grams), np.arange(len(grams))
        while len(left):
            at = slots[left]
            free = self.keys[at] == 0
            self.keys[at[free]] = grams[left[free]]  # the last of those that collide stays
            done = self.keys[at] == grams[left]
            self.values[at[done]] = logp[left[done]]
            left = left[~done]
            slots[left] = (slots[left] + 1) & (size - 1)

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        mixed = grams * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, grams: np.ndarray) -> np.ndarray:
        """Log probabilities; 0 for an n-gram of another shard."""
        at = self._slot(grams)
        key = self.keys[at]
        values = np.where(key == grams, self.values[at], np.float32(0))
        left = np.flatnonzero((key != grams) & (key != 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            key = self.keys[at[left]]
            hit = key == grams[left]
            values[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (key != 0)]
        return values


def _score(docs: DataFrame, shard: DataFrame, sum_name: str, count_name: str) -> DataFrame:
    """``docs`` with the sum of the shard's log probabilities, and the characters."""
    table = shard.select("gram", F.col("logp").cast("float")).toArrow()
    grams = table.column("gram").to_numpy().astype(np.uint64)
    shared = share(docs.sparkSession, GramScores(grams, table.column("logp").to_numpy()))

    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                sums = np.zeros(part.num_rows)
                sizes = np.zeros(part.num_rows, np.int64)
                data, offsets = text_bytes(part.column("text"))
                for start, end in row_chunks(offsets, GRAM_BYTES):
                    inside = data[offsets[start] : offsets[end]]
                    found, lengths = gram_ids(inside, offsets[start : end + 1] - offsets[start])
                    total = np.concatenate([[0.0], np.cumsum(scores.look_up(found), dtype=float)])
                    ends = np.concatenate([[0], np.cumsum(lengths)])
                    sums[start:end] = np.diff(total[ends])
                    sizes[start:end] = lengths
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(sums), pa.array(sizes)],
                    [*part.schema.names, sum_name, count_name],
                )
        pa.default_memory_pool().release_unused()

    schema = StructType(
        [*docs.schema.fields, StructField(sum_name, DoubleType()), StructField(count_name, LongType())]
    )
    return docs.mapInArrow(mapped, schema)


def score(docs: DataFrame, table: DataFrame, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """``docs`` with ``nll``, the mean negative log probability, and ``n_grams``."""
    shards = max(1, -(-table.count() // shard_grams))
    if shards == 1:
        scored = _score(docs, table, "_sum", "n_grams")
    else:
        narrow = docs.select("doc_id", "text")
        number = F.pmod(F.xxhash64("gram"), F.lit(shards))
        parts = None
        for i in range(shards):
            part = _score(narrow, table.where(number == i), "_sum", "n_grams")
            part = part.select("doc_id", F.xxhash64("text").alias("_text"), "_sum", "n_grams")
            parts = part if parts is None else parts.union(part)
        # Repeated rows score alike, so their mean is the score of one.
        sums = parts.groupBy("doc_id", "_text").agg(
            (F.avg("_sum") * shards).alias("_sum"), F.max("n_grams").alias("n_grams")
        )
        keyed = docs.withColumn("_text", F.xxhash64("text"))
        same = keyed.doc_id.eqNullSafe(sums.doc_id) & (keyed._text == sums._text)
        scored = keyed.join(sums, same, "left").select(
            *[keyed[c] for c in docs.columns], sums["_sum"], sums["n_grams"]
        )
    nll = F.when(F.col("n_grams") > 0, -F.col("_sum") / F.col("n_grams"))
    return scored.withColumn("nll", nll).drop("_sum")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids whose labels all say good and not toxic."""
    judged = labels.groupBy("doc_id").agg(
        F.min(F.coalesce("quality", F.lit(0))).alias("quality"),
        F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )
    return judged.where("doc_id is not null and quality = 1 and toxic = 0").select("doc_id")


def thresholds(held_out: DataFrame, quantile: float = QUANTILE) -> tuple[DataFrame, Column, Column]:
    """(lang, mean_nll, limit): the quantile of the shrunk scores, by language; mean and limit of all.

    Scores are counted in bins of 1/``BIN``, so no task holds them all.
    """
    means = held_out.groupBy("lang").agg(F.avg("nll").alias("mean_nll"))
    same = F.expr("lang <=> _lang")
    near = held_out.join(means.withColumnRenamed("lang", "_lang"), same)
    bins = near.groupBy("lang", F.ceil(shrunk() * BIN).alias("bin")).agg(F.count("*").alias("n"))
    bins = stage(bins, "bins")

    def at_quantile(by: list) -> Column:
        up = Window.partitionBy(*by).orderBy("bin")
        passed = F.sum("n").over(up) >= F.sum("n").over(Window.partitionBy(*by)) * F.lit(quantile)
        return F.when(passed, F.col("bin") / BIN)

    own = bins.withColumn("limit", at_quantile(["lang"])).groupBy("lang").agg(
        F.min("limit").alias("own_limit"), F.sum("n").alias("held_out")
    )
    pooled_bins = bins.groupBy("bin").agg(F.sum("n").alias("n"))
    ranked = pooled_bins.withColumn("limit", at_quantile([F.lit(1)]))
    pooled = F.lit(ranked.agg(F.min("limit")).first()[0]).cast("double")
    limit = F.when(F.col("held_out") >= LEAST_HELD_OUT, F.col("own_limit")).otherwise(
        F.greatest(F.col("own_limit"), pooled)
    )
    by_language = own.join(means.withColumnRenamed("lang", "_lang"), same).select(
        "lang", "mean_nll", limit.alias("limit")
    )
    mean = F.lit(held_out.agg(F.avg("nll")).first()[0]).cast("double")
    return by_language, mean, pooled


def shrunk() -> Column:
    """The score with ``PRIOR_CHARS`` characters at the language's mean added."""
    n = F.col("n_grams")
    return (F.col("nll") * n + F.col("mean_nll") * PRIOR_CHARS) / (n + PRIOR_CHARS)


RESULT = ("n_grams", "nll", "perplexity", "threshold", "keep")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``docs`` with n_grams, nll, perplexity, threshold and keep, in place of columns so named."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULT])
    used, _ = aside(docs, ("doc_id", "text", "lang"))
    judged = _classify(used, labels, quantile)
    renamed = dict(zip(used.columns, docs.columns))
    return judged.select(*[F.col(a).alias(b) for a, b in renamed.items()], *RESULT)


def accepted(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with the same columns."""
    used, back = aside(docs, ("doc_id", "text", "lang"))
    return back(_classify(used, labels, quantile).where("keep"))


def _classify(docs: DataFrame, labels: DataFrame, quantile: float) -> DataFrame:
    # Trusted and held-out flags; the mark is on the looked-up side.
    marks = stage(trusted_ids(labels).withColumn("_trusted", F.lit(True)), "trusted")
    marked = join_lookup(docs, marks, "doc_id", "left")
    held = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT_OF)) == 0
    texts = marked.select("text", (F.coalesce("_trusted", F.lit(False)) & ~held).alias("train"))
    table = stage(log_probabilities(stage(gram_table(texts), "grams")), "kn-logp")
    calibration = marked.where(F.col("_trusted") & held).select("doc_id", "text", "lang")
    with freed_when_left():
        scores = score(calibration, table).where("nll is not null").select("lang", "nll", "n_grams")
        scores = stage(scores, "held-out")
    limits, mean, pooled = thresholds(scores, quantile)
    judged = score(docs, table).join(
        F.broadcast(limits.withColumnRenamed("lang", "_lang")), F.expr("lang <=> _lang"), "left"
    )
    judged = judged.withColumn("mean_nll", F.coalesce("mean_nll", mean)).withColumn(
        "limit", F.coalesce("limit", pooled)
    )
    return judged.select(
        *docs.columns,
        "n_grams",
        "nll",
        F.exp("nll").alias("perplexity"),
        F.col("limit").alias("threshold"),
        F.coalesce(shrunk() <= F.col("limit"), F.lit(True)).alias("keep"),
    )
