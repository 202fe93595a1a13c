"""Removal of repeated byte strings by sorting suffixes, shallow first, then deep.

A byte is removed if a string of ``LENGTH`` = 100 bytes that covers it also starts
earlier: in a document with a smaller id, or earlier in the same one.

Sorting all suffixes is spread over the cluster as follows.  Every window of 100
bytes has an anchor, the place among its runs of ``ANCHOR`` bytes with the least
hash; equal windows have equal anchors.  Consecutive windows with one anchor
form a run, and only runs with equal anchors have to be compared.

1. Runs are described by a hash of the anchor, a hash of all their bytes, their
   document and place, without the bytes, packed into one block per task
   and bucket of anchors.  Of runs of one content in a task all but the first
   are covered, and only the first is sent on.
2. In each bucket, runs whose anchor occurs once are dropped.  Of runs
   of one content all but the first are covered.  Anchors with several
   contents need a comparison of bytes.
3. The bytes of these, one run per content, are fetched, and their suffixes
   are sorted to 100 bytes: by a multikey quicksort on characters of eight
   bytes to the depth ``SHALLOW``, then, where longer prefixes agree, by blind
   tries, which branch at the first byte at which a group differs and skip
   what lies between.  Of equal suffixes all but the earliest are covered.
4. The covered stretches of each document are joined and cut out.

Anchors around which very many documents differ (found on a sample, which only
decides how work is spread) are not compared as runs: each of their windows is
then a run of its own, with its content as anchor, and spreads over all buckets.

Edge cases: null and empty texts and texts under 100 bytes lose nothing; rows
that repeat id and text are one document and all get its result; documents with
one id and different texts follow one another by a hash of their text, and
null ids come last; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.batches import row_chunks, text_bytes
from tillroll.operators.joins import join_lookup
from tillroll.session import stage

LENGTH = 100
ANCHOR = 40
SHALLOW = 32
CHUNK = 1 << 20
PLACE_BITS = np.uint64(22)  # a chunk with its overhang has fewer places
BUCKET_RUNS = 1 << 19
BUCKET_BYTES = 1 << 23
FLUSH_RUNS = 1 << 21
SAMPLE_DOCUMENTS = 4000
HEAVY_SHARE = 0.02

MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x2545F4914F6CDD1D
INVERSE = pow(BASE, -1, 1 << 64)
# anchor, content, key, place, windows
RUN = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("key", "<i8"), ("at", "<i4"), ("n", "<i4")])

_powers: dict[int, np.ndarray] = {}


def _power(base: int, count: int) -> np.ndarray:
    """Powers of ``base`` modulo 2**64, from the 0th on."""
    if base not in _powers:
        table = np.full(CHUNK + 4 * LENGTH, base, np.uint64)
        table[0] = 1
        _powers[base] = np.cumprod(table)
    return _powers[base][:count]


def _mixed(words: np.ndarray) -> np.ndarray:
    words = (words ^ (words >> np.uint64(32))) * MIX
    return words ^ (words >> np.uint64(29))


def _words(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from each place on."""
    data = np.ascontiguousarray(data)
    return np.ndarray((max(len(data) - 7, 0),), kind, data, strides=(1,))


def chunk_runs(data: np.ndarray, offsets: np.ndarray, heavy: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Runs of the texts in a chunk: anchor, content, text number, place in the chunk, windows."""
    none = tuple(np.empty(0, t) for t in ("u8", "u8", "i8", "i8", "i8"))
    if len(data) < LENGTH:
        return none
    hashes = _mixed(_words(data))
    places = np.arange(len(hashes), dtype=np.uint64)
    low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    least = (hashes & ~low) | places
    span, width = LENGTH - ANCHOR + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    anchor_at = (least & low).astype(np.int64)[: len(data) - LENGTH + 1]
    lengths = np.diff(offsets)
    windows = np.maximum(lengths - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), windows)
    start = np.arange(windows.sum()) + np.repeat(offsets[:-1] - (np.cumsum(windows) - windows), windows)
    if not len(start):
        return none
    at = anchor_at[start]
    first = np.ones(len(start), bool)
    first[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(first)
    count = np.diff(np.append(begin, len(start)))
    place, anchor, text = start[begin], at[begin], owner[begin]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _power(BASE, len(hashes)))])

    def content(of: np.ndarray, n: np.ndarray) -> np.ndarray:
        size = n + (LENGTH - 8)  # places of eight bytes inside
        value = (sums[of + size] - sums[of]) * _power(INVERSE, len(hashes))[of]
        return _mixed(value ^ n.astype(np.uint64))

    key = hashes[anchor]
    for word in range(8, ANCHOR, 8):
        key = _mixed(key ^ hashes[anchor + word])
    value = content(place, count)
    if heavy is not None and len(heavy):
        spread = np.isin(key, heavy)
        if spread.any():
            inner = np.cumsum(count[spread]) - count[spread]
            one_place = np.repeat(place[spread] - inner, count[spread]) + np.arange(count[spread].sum())
            ones = np.ones(len(one_place), np.int64)
            one_value = content(one_place, ones)
            keep = ~spread
            key = np.concatenate([key[keep], one_value])
            value = np.concatenate([value[keep], one_value])
            text = np.concatenate([text[keep], np.repeat(text[spread], count[spread])])
            place = np.concatenate([place[keep], one_place])
            count = np.concatenate([count[keep], ones])
    return key, value, text, place, count


def _batch_runs(batch: pa.RecordBatch, heavy: np.ndarray | None) -> Iterator[np.ndarray]:
    """Runs of a batch, chunk by chunk; long texts are cut with an overhang."""
    data, offsets = text_bytes(batch.column("text"))
    keys = batch.column("key").to_numpy(zero_copy_only=False)
    for start, end in row_chunks(offsets, CHUNK):
        low, high = int(offsets[start]), int(offsets[end])
        for cut in range(low, high, CHUNK):
            part = np.clip(offsets[start : end + 1], cut, min(cut + CHUNK + LENGTH - 1, high)) - cut
            key, value, text, place, count = chunk_runs(data[cut : cut + int(part[-1])], part, heavy)
            runs = np.empty(len(key), RUN)
            runs["anchor"], runs["content"], runs["n"] = key, value, count
            runs["key"] = keys[start + text]
            runs["at"] = place + cut - offsets[start + text]
            yield runs


def _first_of_each(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs by anchor, content and place, and which are the first of their content."""
    runs = runs[np.lexsort((runs["at"], runs["key"], runs["content"], runs["anchor"]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs["anchor"][1:] != runs["anchor"][:-1]) | (runs["content"][1:] != runs["content"][:-1])
    return runs, first


def _stretches(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping and adjoining stretches of each key joined."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order].astype(np.int64), end[order].astype(np.int64)
    number = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    reach = np.int64(1) << np.int64(32)  # keeps the running end of one key from the next's
    running = np.maximum.accumulate(end + number * reach)
    new = np.ones(len(key), bool)
    new[1:] = start[1:] + number[1:] * reach > running[:-1]
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(key)) - 1
    return key[begin], start[begin], running[last] - number[last] * reach


COVERED, COMPARE = 1, 2
FOUND = "kind int, anchor long, key long, at int, size int"


def _rows(kind: int, anchor: np.ndarray, key: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(key), kind, np.int32)),
            pa.array(np.asarray(anchor, np.uint64).view(np.int64)),
            pa.array(np.asarray(key, np.int64)),
            pa.array(np.asarray(at, np.int32)),
            pa.array(np.asarray(size, np.int32)),
        ],
        ["kind", "anchor", "key", "at", "size"],
    )


def heavy_anchors(texts: DataFrame, documents: int) -> np.ndarray:
    """Anchors with different runs in more than ``HEAVY_SHARE`` of a sample of the documents.

    A document of the sample holds a bounded part of all anchors, so there are few
    such anchors, whatever the number of documents.
    """
    share = min(1.0, SAMPLE_DOCUMENTS / max(documents, 1))
    sample = texts.sample(share, seed=1) if share < 1 else texts

    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for runs in _batch_runs(batch, None):
                pairs = np.unique(runs[["anchor", "content"]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[c].view(np.int64)) for c in ("anchor", "content")], ["anchor", "content"]
                )

    least = max(HEAVY_SHARE * min(SAMPLE_DOCUMENTS, documents), 40)
    counts = sample.mapInArrow(mapped, "anchor long, content long").distinct().groupBy("anchor").count()
    rows = counts.where(F.col("count") > least).select("anchor").collect()
    return np.array([r.anchor for r in rows], np.int64).view(np.uint64)


def repeated_runs(texts: DataFrame, documents: int, size: int) -> DataFrame:
    """Covered stretches, and runs to compare, of (key, text) with unique keys."""
    buckets = -(-size // (BUCKET_RUNS * (LENGTH - ANCHOR + 1) // 2)) or 1
    heavy = texts.sparkSession.sparkContext.broadcast(heavy_anchors(texts, documents))

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            runs, first = _first_of_each(np.concatenate(held))
            held.clear()
            names, blocks = [], []
            rest = runs[~first]
            stretch = _stretches(rest["key"], rest["at"], rest["at"] + rest["n"] + (LENGTH - 1))
            if len(stretch[0]):
                known = np.zeros(len(stretch[0]), RUN)
                known["key"], known["at"], known["n"] = stretch[0], stretch[1], stretch[2] - stretch[1]
                names.append(-1 - int(stretch[0][0] % buckets))
                blocks.append(known.tobytes())
            runs = runs[first]
            bucket = (runs["anchor"] >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            runs, bucket = runs[order], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in range(buckets):
                if cuts[b + 1] > cuts[b]:
                    names.append(b)
                    part = runs[cuts[b] : cuts[b + 1]]
                    # Column by column, which compresses better.
                    blocks.append(b"".join(np.ascontiguousarray(part[c]).tobytes() for c in RUN.names))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "runs"]
            )

        waiting = 0
        for batch in batches:
            for runs in _batch_runs(batch, heavy.value):
                held.append(runs)
                waiting += len(runs)
                if waiting > FLUSH_RUNS:
                    yield from flush()
                    waiting = 0
        if waiting:
            yield from flush()

    def joined(table: pa.Table) -> pa.Table:
        blocks = table.column("runs").to_pylist()
        if table.column("bucket")[0].as_py() < 0:
            known = np.frombuffer(b"".join(blocks), RUN)
            return pa.Table.from_batches(
                [_rows(COVERED, known["anchor"], known["key"], known["at"], known["n"])]
            )
        parts = []
        for block in blocks:
            part, at = np.empty(len(block) // RUN.itemsize, RUN), 0
            for name in RUN.names:
                column = np.frombuffer(block, RUN[name], len(part), at)
                part[name], at = column, at + column.nbytes
            parts.append(part)
        runs, first = _first_of_each(np.concatenate(parts))
        head = np.ones(len(runs), bool)
        head[1:] = runs["anchor"][1:] != runs["anchor"][:-1]
        contents = np.add.reduceat(first.astype(np.int64), np.flatnonzero(head)) if len(runs) else []
        several = np.repeat(contents, np.diff(np.append(np.flatnonzero(head), len(runs)))) > 1
        rest, compare = runs[~first], runs[first & several]
        return pa.Table.from_batches(
            [
                _rows(COVERED, rest["anchor"], rest["key"], rest["at"], rest["n"] + (LENGTH - 1)),
                _rows(COMPARE, compare["anchor"], compare["key"], compare["at"], compare["n"] + (LENGTH - 1)),
            ]
        )

    blocks = texts.mapInArrow(packed, "bucket int, runs binary")
    return blocks.groupBy("bucket").applyInArrow(joined, FOUND)


def _lead_bytes(difference: np.ndarray) -> np.ndarray:
    """Number of leading zero bytes of each word; 8 for zero."""
    count = np.zeros(len(difference), np.int64)
    for bits in range(56, -1, -8):
        count += difference < (np.uint64(1) << np.uint64(bits))
    return count


class Sorted(NamedTuple):
    order: np.ndarray  # suffixes, in lexical order
    group: np.ndarray  # number of the equal strings that each, in that order, belongs to


def deep_shallow_sort(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> Sorted:
    """Sort the strings of ``length`` bytes at ``starts``.

    Groups of equal prefixes are split in rounds, all groups at once.  Up to the
    depth ``shallow`` a round sorts each group by its next eight bytes, as one
    character.  Below, a group is a blind trie: the strings are compared with the
    group's first only, the least common prefix is where the trie branches, and
    a round sorts by the byte at that place; groups without a branch before
    ``length`` are equal.
    """
    padded = np.concatenate([data, np.zeros(length + 16, np.uint8)])
    words = _words(padded, ">u8")
    order = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)  # place of the group's first in the order

    def split(active: np.ndarray, character: np.ndarray) -> np.ndarray:
        """Sort the active places within their groups; those still in a group of several."""
        inner = np.lexsort((character, group[active]))
        order[active], characters = order[active[inner]], character[inner]
        same = group[active]
        new = np.ones(len(active), bool)
        new[1:] = (same[1:] != same[:-1]) | (characters[1:] != characters[:-1])
        begin = np.flatnonzero(new)
        sizes = np.diff(np.append(begin, len(active)))
        group[active] = np.repeat(active[begin], sizes)
        return active[np.repeat(sizes, sizes) > 1]

    active = np.arange(len(starts))
    for depth in range(0, shallow, 8):
        if len(active):
            active = split(active, words[starts[order[active]] + depth].astype(np.uint64))
    depth = np.full(len(starts), shallow, np.int64)  # by place: bytes known to be equal
    while len(active):
        head = starts[order[group[active]]]
        own = starts[order[active]]
        common = depth[active].copy()
        going = np.arange(len(active))
        while len(going):
            at = common[going]
            equal = _lead_bytes((words[own[going] + at] ^ words[head[going] + at]).astype(np.uint64))
            common[going] += equal
            going = going[(equal == 8) & (common[going] < length)]
        common = np.minimum(common, length)
        begin = np.flatnonzero(np.concatenate([[True], group[active][1:] != group[active][:-1]]))
        sizes = np.diff(np.append(begin, len(active)))
        branch = np.repeat(np.minimum.reduceat(common, begin), sizes)
        unequal = branch < length
        active, branch = active[unequal], branch[unequal]
        if len(active):
            depth[active] = branch
            active = split(active, padded[starts[order[active]] + branch].astype(np.uint64))
            depth[active] += 1
    return Sorted(order, group)


def _compared(table: pa.Table) -> pa.Table:
    """Covered windows of runs with one anchor and different contents."""
    bodies = table.column("body").combine_chunks()
    data, offsets = text_bytes(bodies.cast(pa.large_binary()).view(pa.large_string()))
    keys = table.column("key").to_numpy()
    at = table.column("at").to_numpy().astype(np.int64)
    windows = np.diff(offsets) - LENGTH + 1
    run = np.repeat(np.arange(len(keys)), windows)
    inner = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    order, group = deep_shallow_sort(data, offsets[run] + inner)
    run, inner = run[order], inner[order]
    key, place = keys[run], at[run] + inner
    earliest = np.lexsort((place, key, group))
    ranked = group[earliest]
    first = np.ones(len(ranked), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    later = earliest[~first]
    key, start, end = _stretches(key[later], place[later], place[later] + LENGTH)
    return pa.Table.from_batches([_rows(COVERED, np.zeros(len(key)), key, start, end - start)])


def _listed(found: DataFrame, *columns: str) -> DataFrame:
    """(key, list): the rows of each document as one string."""
    entry = F.concat_ws(":", *[F.col(c).cast("string") for c in columns])
    return found.groupBy("key").agg(F.array_join(F.collect_list(entry), ",").alias("list"))


def compared_runs(texts: DataFrame, found: DataFrame) -> DataFrame:
    """The covered stretches among runs that have to be compared byte by byte."""
    compare = found.where(F.col("kind") == COMPARE)
    size = compare.agg(F.sum("size")).first()[0] or 0
    buckets = -(-size // BUCKET_BYTES) or 1
    wanted = stage(_listed(compare, "anchor", "at", "size"), "compare")

    def bodies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, (key, listed) in enumerate(zip(batch.column("key").to_pylist(), batch.column("list").to_pylist())):
                runs = np.array([r.split(":") for r in listed.split(",")], np.int64)
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((runs[:, 0] % buckets).astype(np.int32)),
                        pa.array(np.full(len(runs), key)),
                        pa.array(runs[:, 1].astype(np.int32)),
                        pa.array([text[a : a + n] for _, a, n in runs.tolist()], pa.binary()),
                    ],
                    ["bucket", "key", "at", "body"],
                )

    fetched = join_lookup(texts, wanted, "key").mapInArrow(
        bodies, "bucket int, key long, at int, body binary"
    )
    return fetched.groupBy("bucket").applyInArrow(_compared, FOUND)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        removed, spans, kept = [], [], []
        for i, listed in enumerate(batch.column("list").to_pylist()):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            start = end = np.empty(0, np.int64)
            if listed:
                pairs = np.array([r.split(":") for r in listed.split(",")], np.int64)
                _, start, end = _stretches(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs.sum(axis=1))
            removed.append(int((end - start).sum()))
            spans.append(len(start))
            borders = [0, *np.column_stack([start, end]).ravel().tolist(), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(borders[::2], borders[1::2])))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.diff(offsets)),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                pa.array(kept, pa.binary()),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, text) of all rows, and one (key, text) per document, keys in order.

    The key is the id where ids are unique, otherwise the place of id and text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    odd = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if odd.isEmpty():
        keyed = rows.select("doc_id", F.col("doc_id").alias("key"), "text")
        return keyed, keyed.select("key", "text")
    name = F.concat_ws(
        ":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text").cast("string")
    )
    named = rows.withColumn("name", name).withColumn("hash", F.xxhash64("text"))
    ranked = named.select("doc_id", "hash", "name").distinct().orderBy(F.asc_nulls_last("doc_id"), "hash")
    numbers = ranked.select("name").rdd.zipWithIndex().map(lambda pair: (pair[0][0], pair[1]))
    numbers = stage(docs.sparkSession.createDataFrame(numbers, "name string, key long"), "keys")
    keyed = join_lookup(named, numbers, "name").select("doc_id", "key", "text")
    return keyed, keyed.dropDuplicates(["key"]).select("key", "text")


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row; ``kept`` is its text as bytes."""
    keyed, texts = _keyed(docs)
    documents, size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    found = stage(repeated_runs(texts, documents, size or 0), "runs")
    covered = found.where(F.col("kind") == COVERED).unionByName(compared_runs(texts, found))
    listed = stage(_listed(covered, "at", "size"), "covered")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return join_lookup(keyed, listed, "key", "left").select("doc_id", "text", "list").mapInArrow(_cut, schema)
