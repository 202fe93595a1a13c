"""Document fingerprints from closed syncmers, matched by position.

A run of ``K`` bytes is a closed syncmer if the least hash among its runs of
``S`` bytes stands at its first or last place.  That depends on the run alone,
so texts that share a passage share the anchors inside it, whatever stands
around.  A fingerprint is the sequence of a text's anchors, 8 hex digits each,
in order of their first places.  Two fingerprints are as alike as the longest
chain of anchors that both hold in the same order is long: twice its length
over the anchors of both.

Edge cases: a text shorter than ``K`` bytes has its whole self as only anchor; null
and empty texts have none, and two such are alike (1), one such and another
text are not (0); documents with one id follow one another by a hash of their
text; null ids come last; a single document is its own next; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.batches import slices
from tillroll.operators.joins import join_lookup
from tillroll.session import stage

K = 48
S = 8
BUCKET_BYTES = 1 << 24
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(words: np.ndarray) -> np.ndarray:
    words = (words ^ (words >> np.uint64(32))) * MIX
    return words ^ (words >> np.uint64(29))


def anchors(texts: list[str]) -> list[np.ndarray]:
    """Each text's distinct anchors (32 bits), in order of their first places."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    found = [np.array([_whole(r)] if r else [], np.uint32) for r in raw]
    long = [i for i, r in enumerate(raw) if len(r) >= K]
    if not long:
        return found
    data = b"".join(raw[i] for i in long)
    lengths = np.array([len(raw[i]) for i in long])
    ends = np.cumsum(lengths)
    inner = np.ndarray((len(data) - S + 1,), "<u8", data, strides=(1,))
    hashes = _mixed(inner)
    span = K - S + 1  # places of an S-run in a K-run
    least, width = hashes, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    last = hashes[span - 1 :]
    places = np.flatnonzero((least == hashes[: len(least)]) | (least == last))
    owner = np.searchsorted(ends, places, "right")
    inside = places + K <= ends[owner]
    places, owner = places[inside], owner[inside]
    value = np.zeros(len(places), np.uint64)
    for word in range(0, K, 8):
        value = _mixed(value ^ inner[places + word])
    short = (value >> np.uint64(32)).astype(np.uint32)
    # The first of equal anchors in a text stays.
    key = owner.astype(np.uint64) << np.uint64(32) | short
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.ones(len(order), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    kept = np.sort(order[first])
    cuts = np.searchsorted(owner[kept], np.arange(len(long) + 1))
    for n, i in enumerate(long):
        found[i] = short[kept[cuts[n] : cuts[n + 1]]]
    for i in long:
        if not len(found[i]):
            found[i] = np.array([_whole(raw[i])], np.uint32)
    return found


def _whole(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=4).digest(), "little")


def printed(found: np.ndarray) -> str:
    return found.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the longest chain of common anchors in the same order, over all anchors."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    order = np.argsort(b)
    at = np.searchsorted(b[order], a)
    at[at == len(b)] = 0
    places = order[at][b[order[at]] == a]
    if len(places) > 1 and (np.diff(places) < 0).any():
        chain: list[int] = []
        for place in places.tolist():
            i = bisect_left(chain, place)
            chain[i : i + 1] = [place]
        common = len(chain)
    else:
        common = len(places)
    return 2 * common / (len(a) + len(b))


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the next text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _followed(docs: DataFrame) -> DataFrame:
    """(bucket, carry, doc_id, text): runs of consecutive documents, descending ids.

    A bucket is a range of ids with about ``BUCKET_BYTES`` of text.  Its rows are
    followed by a copy, marked ``carry``, of the first document of the next
    bucket that has one; the first follows the last.  The ranges come from a
    stored table of the ids; one row per bucket reaches the driver.
    """
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = -(-size // BUCKET_BYTES) or 1
    ids = stage(keyed.select("doc_id", "text_hash").repartitionByRange(wanted, F.desc("doc_id")), "ids")
    part = ids.groupBy(F.input_file_name()).agg(F.max("doc_id").alias("top"))
    tops = sorted(row.top for row in part.collect() if row.top is not None)

    bounds = np.array(tops[:-1], np.int64)  # the highest range has no upper bound

    @F.pandas_udf("int")
    def bucket_of(doc_id: pd.Series) -> pd.Series:
        known = doc_id.notna()
        place = np.searchsorted(bounds, doc_id.fillna(0).astype("int64").to_numpy(), "left")
        return pd.Series(np.where(known, len(bounds) - place, len(bounds)), dtype="int32")

    firsts = ids.withColumn("bucket", bucket_of("doc_id")).groupBy("bucket").agg(
        F.min_by(
            F.struct("doc_id", "text_hash"),
            F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), "text_hash"),
        ).alias("first")
    )
    rows = sorted(firsts.collect(), key=lambda row: row.bucket)
    carried = [
        (row.first.doc_id, row.first.text_hash, rows[i - 1].bucket) for i, row in enumerate(rows)
    ]
    schema = "_id long, _hash long, into int"
    into = docs.sparkSession.createDataFrame(carried, schema).select(
        F.concat_ws(":", F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.coalesce("_hash", F.lit(0))).alias("key"),
        "into",
    )
    key = F.concat_ws(
        ":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text_hash", F.lit(0))
    )
    marked = join_lookup(
        keyed.withColumn("bucket", bucket_of("doc_id")).withColumn("key", key), into, "key", "left"
    )
    places = F.array_compact(
        F.array(
            F.struct("bucket", F.lit(False).alias("carry")),
            F.when(F.col("into").isNotNull(), F.struct(F.col("into").alias("bucket"), F.lit(True).alias("carry"))),
        )
    )
    dealt = marked.select("doc_id", "text", "text_hash", F.inline(places))
    return (
        dealt.repartitionByRange(wanted, "bucket")
        .sortWithinPartitions("bucket", "carry", F.desc_nulls_last("doc_id"), "text_hash")
        .select("bucket", "carry", "doc_id", "text")
    )


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pending: list[tuple] = []
    for batch in batches:
        for part in slices(batch, "text"):
            columns = [part.column(c).to_pylist() for c in ("bucket", "carry", "doc_id", "text")]
            rows = pending + [(b, c, d, t or "") for b, c, d, t in zip(*columns)]
            pending = rows[-1:]
            texts = [row[3] for row in rows]
            pairs = [
                i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]
            ]
            if not pairs:
                continue
            edits = [edited_text(texts[i], texts[i + 1]) for i in pairs]
            own, changed = anchors(texts), anchors(edits)
            hashed = [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][2] for i in pairs], pa.int64()),
                    pa.array([len(texts[i]) for i in pairs], pa.int64()),
                    pa.array(hashed, pa.string()),
                    pa.array([printed(own[i]) for i in pairs], pa.string()),
                    pa.array([printed(c) for c in changed], pa.string()),
                    pa.array([likeness(own[i], c) for i, c in zip(pairs, changed)], pa.float64()),
                    pa.array([likeness(own[i], own[i + 1]) for i in pairs], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each document and of its edited text, and how near the text and the next are."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return _followed(rows).mapInArrow(
        _records,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )
