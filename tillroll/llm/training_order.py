"""Token ids in training order: a keyed permutation gives every sequence its slot.

Each text is tokenised with a public vocabulary, closed with an end token and cut
into sequences of ``SEQUENCE`` ids, the last one filled up with end tokens.
Sequences are numbered gaplessly in an order that depends on the documents
alone; a keyed Feistel network over the next even number of bits permutes
the numbers, and a number that lands outside of the range walks on until it
is inside, so that the slots are a permutation of 0 to n - 1.  Rows are then
dealt by ranges of slots, a shard of ``SHARD_SLOTS`` each, and sorted.

``write_shards`` writes one file per shard in which every record has the same
stride: ids as little-endian 16 or 32 bits and one separator byte.  A reader that
stopped at a slot goes on from ``slot % SHARD_SLOTS * stride`` in shard
``slot // SHARD_SLOTS``; ``read_from`` does this.

Edge cases: null and empty texts give one sequence of end tokens, so that no
document goes missing (``n_tokens`` counts the first end token only); repeated
rows get slots of their own; a null id is kept; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.llm.batches import slices
from tillroll.operators.joins import join_lookup
from tillroll.session import stage

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level vocabularies of this kind cut a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEQUENCE = 512
SHARD_SLOTS = 1 << 15
KEY = 20_240_607
ROUNDS = 6
BUCKETS = 4096
SEPARATOR = b"\n"

_encodings: dict[str, object] = {}


def encoding(vocabulary: str):
    """The tokenizer of a vocabulary file, loaded once in each process."""
    if vocabulary not in _encodings:
        import tiktoken

        pairs = map(bytes.split, Path(vocabulary).read_bytes().splitlines())
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        _encodings[vocabulary] = tiktoken.Encoding(
            Path(vocabulary).stem, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}
        )
    return _encodings[vocabulary]


def id_type(vocabulary: str) -> tuple[str, int]:
    """Type of an id, and the id of the end token: the first that is free."""
    end = encoding(vocabulary).n_vocab
    return ("<u2" if end < 1 << 16 else "<u4"), end


def tokenised(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text_hash, n_tokens, ids): the ids of each text, closed by the end token."""

    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(vocabulary)
        kind, end = id_type(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [
                    np.array([*tokenizer.encode_ordinary(t or ""), end], kind)
                    for t in part.column("text").to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_hash"),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([i.tobytes() for i in ids], pa.binary()),
                    ],
                    ["doc_id", "text_hash", "n_tokens", "ids"],
                )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(mapped, "doc_id long, text_hash long, n_tokens long, ids binary")


def _key() -> list:
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_hash")]


def numbered(tokens: DataFrame, sequence: int = SEQUENCE) -> tuple[DataFrame, int]:
    """(key, first, copies) for each document, and the number of sequences.

    Documents are dealt to buckets by a hash; the buckets' sequences are added
    up, then those within each bucket.  Equal rows have one entry and take
    consecutive runs of numbers.
    """
    lengths = tokens.select(
        F.concat_ws(":", *_key()).alias("key"), F.ceil(F.col("n_tokens") / sequence).alias("n")
    )
    each = lengths.groupBy("key", "n").agg(F.count("*").alias("copies")).withColumn(
        "bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS))
    )
    each = stage(each.withColumn("all", F.col("n") * F.col("copies")), "lengths")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = each.groupBy("bucket").agg(F.sum("all").alias("all"))
    starts = buckets.select("bucket", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("at", F.coalesce(F.sum("all").over(inside), F.lit(0)))
    first = placed.join(F.broadcast(starts), "bucket")  # at most BUCKETS rows
    total = each.agg(F.sum("all")).first()[0] or 0
    return first.select("key", (F.col("start") + F.col("at")).alias("first"), "n", "copies"), total


def feistel(numbers: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """The slots of ``numbers`` below ``size``, by a keyed permutation with cycle-walking."""
    half = max((max(size - 1, 1).bit_length() + 1) // 2, 1)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(0, 1 << 63, ROUNDS, dtype=np.uint64) * 2 + 1

    def once(values: np.ndarray) -> np.ndarray:
        left, right = values >> np.uint64(half), values & mask
        for k in keys:
            mixed = (right + np.uint64(1)) * k
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            left, right = right, left ^ ((mixed >> np.uint64(64 - half)) & mask)
        return left << np.uint64(half) | right

    slots = once(numbers.astype(np.uint64))
    while (outside := np.flatnonzero(slots >= size)).size:
        slots[outside] = once(slots[outside])
    return slots.astype(np.int64)


def training_order(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    sequence: int = SEQUENCE,
    shard_slots: int = SHARD_SLOTS,
    key: int = KEY,
) -> DataFrame:
    """(slot, shard, byte_offset, doc_id, part, n_tokens, ids), by shard in order of slots."""
    tokens = stage(tokenised(docs, vocabulary), "tokens")
    first, total = numbered(tokens, sequence)
    first = stage(first, "numbers")
    keyed = tokens.withColumn("key", F.concat_ws(":", *_key()))
    unique = join_lookup(keyed, first, "key")
    repeated = first.where("copies > 1")
    if not repeated.isEmpty():
        # Which copy a row is: only rows of repeated keys are numbered.
        again = join_lookup(keyed, repeated, "key").withColumn(
            "copy", F.row_number().over(Window.partitionBy("key").orderBy("n_tokens")) - 1
        )
        again = again.withColumn("first", F.col("first") + F.col("copy") * F.col("n")).drop("copy")
        unique = unique.where("copies = 1").unionByName(again)
    kind, end = id_type(vocabulary)
    width = np.dtype(kind).itemsize

    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fill = np.array([end], kind).tobytes()
        for batch in batches:
            for rows in slices_by_ids(batch):
                ids, counts = rows.column("ids").to_pylist(), rows.column("n").to_numpy()
                parts = np.concatenate([np.arange(c) for c in counts])
                owner = np.repeat(np.arange(len(ids)), counts)
                numbers = np.repeat(rows.column("first").to_numpy(), counts) + parts
                cut = [
                    ids[o][p * sequence * width : (p + 1) * sequence * width]
                    for o, p in zip(owner.tolist(), parts.tolist())
                ]
                real = [len(c) // width for c in cut]
                full = [c + fill * (sequence - r) for c, r in zip(cut, real)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(feistel(numbers, total, key)),
                        rows.column("doc_id").take(pa.array(owner)),
                        pa.array(parts.astype(np.int64)),
                        pa.array(real, pa.int64()),
                        pa.array(full, pa.binary()),
                    ],
                    ["slot", "doc_id", "part", "n_tokens", "ids"],
                )

    slots = unique.select("doc_id", "first", "n", "ids").mapInArrow(
        mapped, "slot long, doc_id long, part long, n_tokens long, ids binary"
    )
    stride = sequence * width + len(SEPARATOR)
    shard = F.floor(F.col("slot") / shard_slots)
    offset = F.pmod("slot", F.lit(shard_slots)) * stride
    return (
        slots.select("slot", shard.alias("shard"), offset.alias("byte_offset"), "doc_id", "part", "n_tokens", "ids")
        .repartitionByRange(max(1, -(-total // shard_slots)), "shard")
        .sortWithinPartitions("shard", "slot")
    )


def slices_by_ids(batch: pa.RecordBatch, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in pieces with about ``limit`` bytes of ids, one row at least."""
    sizes = np.cumsum([0, *(len(i) for i in batch.column("ids").to_pylist())])
    row = 0
    while row < batch.num_rows:
        end = max(int(np.searchsorted(sizes, sizes[row] + limit, "right")) - 1, row + 1)
        yield batch.slice(row, end - row)
        row = end


def write_shards(order: DataFrame, path: str) -> None:
    """One file per shard, records in order of slots, each followed by one separator byte."""
    rows = order.select("shard", F.col("ids").cast("string").alias("value"))
    rows.write.partitionBy("shard").option("lineSep", SEPARATOR.decode()).text(path)


def read_from(
    spark: SparkSession,
    path: str,
    slot: int,
    vocabulary: str = VOCABULARY,
    sequence: int = SEQUENCE,
    shard_slots: int = SHARD_SLOTS,
) -> DataFrame:
    """(slot, ids) from ``slot`` on; shards before it are not opened."""
    stride = sequence * np.dtype(id_type(vocabulary)[0]).itemsize + len(SEPARATOR)

    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content").to_pylist()):
                base = shard * shard_slots
                records = range(max(slot - base, 0), len(content) // stride)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([base + r for r in records], pa.int64()),
                        pa.array([content[r * stride : (r + 1) * stride - 1] for r in records], pa.binary()),
                    ],
                    ["slot", "ids"],
                )

    files = spark.read.format("binaryFile").load(path)
    later = files.where(F.col("shard") >= slot // shard_slots)
    return later.select(F.col("shard").cast("long").alias("shard"), "content").mapInArrow(
        mapped, "slot long, ids binary"
    )
