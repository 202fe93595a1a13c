"""Phrases whose words occur together more often than apart, mined level by level.

The occurrence relation of a length holds (chunk, place, phrase): the words of
a chunk of documents are numbered in order of piece and position, one number
being left out between pieces, so that place + 1 is the next position of the
same piece.  Each relation is persisted sorted by place, a chunk to a row; its
phrases are codes of the chunk's own dictionary, which also has their counts.
A level

* adds the dictionaries up over all chunks and keeps the frequent phrases,
* takes the others out of the dictionaries and the relation (semi-join), and
* merge-joins the relation with itself on place + 1: a frequent phrase and the
  frequent one that starts a word later make the next length's occurrence.

Only dictionaries are shuffled, never occurrences, unless the frequent phrases
are too many to broadcast: then what each chunk needs of them is joined by
shuffle and brought to the chunk.  Phrases of two parts are so many that they are
shuffled as sorted numbers: a task adds some chunks up, spreads the phrases over
buckets by a one-to-one mixing of their numbers and sends of each bucket the
steps from a number to the next, a few bytes each.

Defined results: a null text has no words and a null ``lang`` is ``und``; the
same text twice counts twice, whatever its ``doc_id``, which isn't read; an empty
table gives no rows.  Of phrases with one score and count the bytewise smaller
ranks first.  Counts are longs, and scores are exact while a count has up to
16 digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm.batches import row_chunks, smaller_batches, text_bytes
from tillroll.operators.joins import fits_broadcast, join_lookup
from tillroll.session import new_path, stage

MAX_WORDS = 3
LEAST = 10
TOP = 2000
NO_LANG = "und"
# A row is a chunk of documents, so few rows make a row group.
ROW_GROUP_BYTES = 4 << 20
# Parquet would look at a group's size after 100 rows only, and a reader holds a whole group of arrays.
ROW_GROUPS = {
    "parquet.block.size": ROW_GROUP_BYTES,
    "parquet.page.size.row.check.min": 1,
    "parquet.page.size.row.check.max": 1,
}

# Dictionary entries that a task adds up before it sends them, and those that a bucket gets.
SENT_ENTRIES = 1 << 21
BUCKET_ENTRIES = 1 << 20
SENT_SCHEMA = "bucket int, steps binary, n binary"
MIXER = 0x9E3779B97F4A7C15

_OTHER, _BLANK, _END = 0, 1, 2
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[list(b" \t")] = _BLANK
_KINDS[list(b".,;:!?\n\x0b\x0c\r")] = _END

WORD_SCHEMA = "chunk long, gaps binary, codes binary, lang array<string>, word array<string>, n array<int>"
PAIR_SCHEMA = "chunk long, gaps binary, codes binary, a array<long>, b array<long>, n array<int>"


# From the dictionary of a chunk to an id for each of its codes, -1 if not frequent.
Finder = Callable[[dict[str, pa.Array]], np.ndarray]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts in ``data`` with A-Z lowered, their text's number, their place."""
    data = data + np.uint8(32) * ((data >= 65) & (data <= 90))
    kinds = _KINDS[data]
    inside = kinds == _OTHER
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    starts, ends = offsets[:-1][filled], offsets[1:][filled] - 1
    first[starts] = inside[starts]
    last[ends] = inside[ends]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, begin, "right") - 1
    piece = np.searchsorted(np.flatnonzero(kinds == _END), begin) + doc
    place = np.arange(len(begin)) + np.cumsum(np.diff(piece, prepend=piece[:1]) != 0)
    at = np.zeros(len(begin) + 1, np.int32)
    np.cumsum(end - begin, out=at[1:])
    buffers = [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[inside]))]
    return pa.Array.from_buffers(pa.binary(), len(begin), buffers), doc, place


def _coded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, codes, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return keys, codes, counts


def _one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from zero in the least of 1, 2 or 4 bytes each, after a byte that says so."""
    width = next(w for w in (1, 2, 4) if not len(numbers) or numbers.max() < 1 << 8 * w)
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


def _row(chunk: int, places: np.ndarray, codes: np.ndarray, entries: dict[str, pa.Array]) -> pa.RecordBatch:
    columns = {
        "chunk": pa.array([chunk], pa.int64()),
        "gaps": pa.array([_packed(np.diff(places, prepend=0))], pa.binary()),
        "codes": pa.array([_packed(codes)], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(columns | {name: _one(v) for name, v in entries.items()})


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk = TaskContext.get().partitionId() << 32
    part = None
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        for start, end in row_chunks(np.append(0, np.cumsum(sizes, dtype=np.int64))):
            part = batch.slice(start, end - start)
            words, doc, place = words_of(*text_bytes(part.column("text")))
            if not len(words):
                continue
            words = words.dictionary_encode()
            langs = part.column("lang").dictionary_encode()
            lang = langs.indices.to_numpy(zero_copy_only=False)[doc].astype(np.int64)
            keys, codes, counts = _coded(lang * len(words.dictionary) + words.indices.to_numpy())
            entries = {
                "lang": langs.dictionary.take(pa.array(keys // len(words.dictionary))),
                "word": words.dictionary.take(pa.array(keys % len(words.dictionary))).cast(pa.string()),
                "n": pa.array(counts, pa.int32()),
            }
            yield _row(chunk, place, codes, entries)
            chunk += 1
        del batch, part  # or they would stay while the next batch is read
    pa.default_memory_pool().release_unused()


def _persist(relation: DataFrame, path: str) -> DataFrame:
    spark = relation.sparkSession
    with smaller_batches(spark):
        relation.write.options(**ROW_GROUPS).parquet(path)
    return spark.read.schema(relation.schema).parquet(path)


def word_relation(docs: DataFrame, path: str) -> DataFrame:
    """The occurrence relation of single words, persisted at ``path``."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang")
    rows = docs.select(F.col("text").cast("string").alias("text"), lang)
    return _persist(rows.mapInArrow(_word_rows, WORD_SCHEMA), path)


def _release(spark: SparkSession, path: str) -> None:
    """Free a persisted relation that nothing reads any more."""
    spark.range(0).write.mode("overwrite").parquet(path)


def _entries(relation: DataFrame, *keys: str) -> DataFrame:
    """The dictionaries of all chunks: chunk, code, the keys and the chunk's count."""
    zipped = F.arrays_zip(*keys, "n")
    exploded = relation.select("chunk", F.posexplode(zipped).alias("code", "entry"))
    return exploded.select("chunk", "code", *[f"entry.{k}" for k in (*keys, "n")])


def _counted(relation: DataFrame, *keys: str) -> DataFrame:
    return _entries(relation, *keys).groupBy(*keys).agg(F.sum("n").alias("n"))


class _Mixer:
    """One-to-one mixing of the numbers below ``1 << bits``, which spreads them evenly."""

    def __init__(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.half = np.uint64(-(-bits // 2))
        self.there, self.back = np.uint64(MIXER), np.uint64(pow(MIXER, -1, 1 << 64))

    def _mixed(self, numbers: np.ndarray, factor: np.uint64) -> np.ndarray:
        numbers = numbers * factor & self.mask
        numbers ^= numbers >> self.half  # undone by itself, as it is half the bits or more
        return numbers * factor & self.mask

    def mix(self, numbers: np.ndarray) -> np.ndarray:
        return self._mixed(numbers, self.there)

    def unmix(self, mixed: np.ndarray) -> np.ndarray:
        return self._mixed(mixed, self.back)


def _sent(numbers: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs, all their lowest bytes first."""
    width = max(1, -(-int(numbers.max()).bit_length() // 8))
    octets = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)
    return octets[:, :width].T.tobytes()


def _received(sent: bytes, count: int) -> np.ndarray:
    octets = np.zeros((count, 8), np.uint8)
    octets[:, : len(sent) // count] = np.frombuffer(sent, np.uint8).reshape(-1, count).T
    return octets.view("<u8").ravel()


def _added_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(all_keys)
    all_keys, all_counts = all_keys[order], all_counts[order]
    first = np.flatnonzero(np.append(True, all_keys[1:] != all_keys[:-1]))
    return all_keys[first], np.add.reduceat(all_counts, first)


def _sent_pairs(relation: DataFrame, size: int) -> tuple[DataFrame, _Mixer]:
    """The dictionaries in ``SENT_SCHEMA``, and what the numbers of pairs are mixed with.

    ``a`` and ``b`` are below ``size``.  A bucket has about ``BUCKET_ENTRIES`` entries,
    however many there are.
    """
    entries = relation.agg(F.sum(F.size("n"))).first()[0] or 0
    bucket_bits = max(0, int(-(-entries // BUCKET_ENTRIES) - 1).bit_length())
    bits = max((size * size).bit_length(), bucket_bits + 1)
    mixer, low = _Mixer(bits), np.uint64(bits - bucket_bits)

    def rows(keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        mixed, n = _added_up(keys, counts)
        bucket = (mixed >> low).astype(np.int32)
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(mixed))
        parts = list(zip(cuts[:-1], cuts[1:]))
        steps = [_sent(np.append(mixed[i], np.diff(mixed[i:j]))) for i, j in parts]
        sums = [len(n[i:j]).to_bytes(8, "little") + _sent(n[i:j]) for i, j in parts]
        return pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array(bucket[cuts[:-1]], pa.int32()),
                "steps": pa.array(steps, pa.binary()),
                "n": pa.array(sums, pa.binary()),
            }
        )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, n = (batch.column(c)[i].values.to_numpy() for c in ("a", "b", "n"))
                keys.append(mixer.mix(a.astype(np.uint64) * np.uint64(size) + b.astype(np.uint64)))
                counts.append(n.astype(np.int64))
                held += len(n)
                if held >= SENT_ENTRIES:
                    yield rows(keys, counts)
                    keys, counts, held = [], [], 0
        if held:
            yield rows(keys, counts)
        pa.default_memory_pool().release_unused()

    return relation.select("a", "b", "n").mapInArrow(send, SENT_SCHEMA), mixer


def _pair_counts(relation: DataFrame, size: int, least: int) -> DataFrame:
    """(a, b, n) of the pairs in all dictionaries whose count ``n`` is ``least`` or more."""
    sent, mixer = _sent_pairs(relation, size)

    def add(bucket: pa.Table) -> pa.Table:
        keys, counts = [], []
        for steps, n in zip(bucket.column("steps"), bucket.column("n")):
            n = n.as_py()
            count = int.from_bytes(n[:8], "little")
            keys.append(np.cumsum(_received(steps.as_py(), count), dtype=np.uint64))
            counts.append(_received(n[8:], count).astype(np.int64))
        mixed, n = _added_up(keys, counts)
        frequent = n >= least
        pairs = mixer.unmix(mixed[frequent]).astype(np.int64)
        return pa.table({"a": pairs // size, "b": pairs % size, "n": n[frequent]})

    return sent.groupBy("bucket").applyInArrow(add, "a long, b long, n long")


def _word_finder(frequent: pa.Table) -> Finder:
    by_lang = {}
    lang = frequent.column("lang").combine_chunks().dictionary_encode()
    words = frequent.column("word").combine_chunks()
    ids = frequent.column("id").to_numpy()
    # The rows of a lang lie together, so that these are slices and not copies.
    codes = lang.indices.to_numpy()
    for code, name in enumerate(lang.dictionary.to_pylist()):
        mine = np.flatnonzero(codes == code)
        first, last = mine[0], mine[-1] + 1
        by_lang[name] = words.slice(first, last - first), ids[first:last]

    def find(row: dict[str, pa.Array]) -> np.ndarray:
        found = np.full(len(row["word"]), -1, np.int64)
        for name in pc.unique(row["lang"]):
            if name.as_py() in by_lang:
                known, their_ids = by_lang[name.as_py()]
                mine = np.flatnonzero(pc.equal(row["lang"], name))
                at = pc.fill_null(pc.index_in(row["word"].take(pa.array(mine)), known), -1).to_numpy()
                found[mine[at >= 0]] = their_ids[at[at >= 0]]
        return found

    return find


def _pair_index(frequent: pa.Table) -> tuple[np.ndarray, ...]:
    """Frequent pairs as one sorted number each, made once on the driver."""
    a, b, ids = (frequent.column(c).to_numpy() for c in ("a", "b", "id"))
    firsts, seconds = np.unique(a), np.unique(b)
    keys = np.searchsorted(firsts, a) * len(seconds) + np.searchsorted(seconds, b)
    order = np.argsort(keys)
    return firsts, seconds, keys[order], ids[order]


def _pair_finder(index: tuple[np.ndarray, ...]) -> Finder:
    firsts, seconds, keys, ids = index

    def find(row: dict[str, pa.Array]) -> np.ndarray:
        if not len(ids):
            return np.full(len(row["n"]), -1, np.int64)
        x, y = row["a"].to_numpy(), row["b"].to_numpy()
        i = np.minimum(np.searchsorted(firsts, x), len(firsts) - 1)
        j = np.minimum(np.searchsorted(seconds, y), len(seconds) - 1)
        wanted = np.where((firsts[i] == x) & (seconds[j] == y), i * len(seconds) + j, -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, ids[at], -1)

    return find


def _joined(row: dict[str, pa.Array]) -> np.ndarray:
    """Ids that a join has brought to the chunk."""
    found = np.full(len(row["n"]), -1, np.int64)
    found[row["code"].to_numpy()] = row["id"].to_numpy()
    return found


def _extender(find: Finder, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lists = [f.name for f in batch.schema if pa.types.is_list(f.type)]
                row = {name: batch.column(name)[i].values for name in lists}
                ids = find(row)
                places = np.cumsum(_unpacked(batch.column("gaps")[i].as_py()))
                codes = _unpacked(batch.column("codes")[i].as_py())
                # Semi-join: only occurrences of frequent phrases stay.
                frequent = ids >= 0
                kept = frequent[codes]
                places, codes = places[kept], codes[kept]
                # Merge-join on the next place.
                at = np.flatnonzero(places[1:] == places[:-1] + 1)
                short = np.cumsum(frequent) - 1
                ids, n = ids[frequent], int(frequent.sum())
                keys, new, counts = _coded(short[codes[at]] * np.int64(n) + short[codes[at + 1]])
                if not len(keys):
                    continue
                entries = {
                    "a": pa.array(ids[keys // n]),
                    "b": pa.array(ids[keys % n]),
                    "n": pa.array(counts, pa.int32()),
                }
                nothing = np.empty(0, np.int64)
                where, new = (nothing, nothing) if last else (places[at], new)
                yield _row(batch.column("chunk")[i].as_py(), where, new, entries)

    return extend


def next_relation(
    relation: DataFrame, frequent: DataFrame, keys: tuple[str, str], last: bool, path: str
) -> DataFrame:
    """The relation of phrases one word longer, all of whose parts are frequent, at ``path``.

    ``last`` leaves the occurrences out and keeps only the dictionaries.
    """
    spark = relation.sparkSession
    lookup = frequent.select(*keys, "id")
    columns = ["chunk", "gaps", "codes", "n"]
    if fits_broadcast(lookup):
        collected = lookup.orderBy(keys[0]).toArrow()
        words = keys == ("lang", "word")
        known = spark.sparkContext.broadcast(collected if words else _pair_index(collected))
        finder = _word_finder if words else _pair_finder

        def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _extender(finder(known.value), last)(batches)
            pa.default_memory_pool().release_unused()

        extended = relation.select(*columns, *keys).mapInArrow(extend, PAIR_SCHEMA)
        result = _persist(extended, path)
        known.destroy()
        return result
    found = join_lookup(_entries(relation, *keys), lookup, keys)
    # A chunk's dictionary is as bounded as the chunk.
    kept = found.groupBy("chunk").agg(F.collect_list(F.struct("code", "id")).alias("kept"))
    brought = relation.select(*columns).join(kept, "chunk")
    brought = brought.select(*columns, F.col("kept.code").alias("code"), F.col("kept.id").alias("id"))
    return _persist(brought.mapInArrow(_extender(_joined, last), PAIR_SCHEMA), path)


def _numbered(frequent: DataFrame, name: str) -> DataFrame:
    """``frequent`` as a table with an ``id`` from zero without gaps."""
    placed = stage(frequent.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    # A row for each of the table's partitions.
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts, before = [], 0
    for row in sizes.orderBy("_part").collect():
        starts.append((row["_part"], before - (row["_part"] << 33)))
        before += row["_n"]
    shift = frequent.sparkSession.createDataFrame(starts, "_part long, _shift long")
    shifted = placed.withColumn("_part", part).join(F.broadcast(shift), "_part")
    return shifted.withColumn("id", F.col("_at") + F.col("_shift")).drop("_part", "_shift", "_at")


def frequent_phrases(
    docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST
) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of each length from 1, and the number of words of each ``lang``.

    A phrase has its ``id``, ``lang``, ``words`` and count ``n``; longer ones also
    have the ids ``a`` and ``b`` of all words but the last and all but the first,
    and the counts of what they begin with (``heads``, by length) and end with
    (``tails``).
    """
    spark = docs.sparkSession
    paths = [new_path(spark, f"phrases-{length}") for length in range(1, max_words + 1)]
    relation = word_relation(docs, paths[0])
    totals = relation.select(F.explode(F.arrays_zip("lang", "n")).alias("e"))
    totals = stage(totals.groupBy("e.lang").agg(F.sum("e.n").alias("total")), "totals")
    no_counts = F.array().cast("array<bigint>")
    words = _counted(relation, "lang", "word").where(F.col("n") >= least)
    words = words.withColumns({"words": F.array("word"), "heads": no_counts, "tails": no_counts})
    levels = [_numbered(words, "frequent")]
    keys = ("lang", "word")
    for length in range(2, max_words + 1):
        last = length == max_words
        relation = next_relation(relation, levels[-1], keys, last, paths[length - 1])
        _release(spark, paths[length - 2])
        keys = ("a", "b")
        shorter = levels[-1]
        counts = _pair_counts(relation, shorter.count(), least)
        begins = shorter.select(
            F.col("id").alias("a"),
            "lang",
            F.col("words").alias("_first"),
            F.concat("heads", F.array("n")).alias("heads"),
        )
        ends = shorter.select(
            F.col("id").alias("b"),
            F.slice("words", -1, 1).alias("_last"),
            F.concat("tails", F.array("n")).alias("tails"),
        )
        # The lookups are no smaller than what they are joined with: no broadcast.
        counts = stage(counts, "counts")
        longer = join_lookup(join_lookup(counts, begins, "a", small=False), ends, "b", small=False)
        longer = longer.withColumn("words", F.concat("_first", "_last")).drop("_first", "_last")
        levels.append(_numbered(longer, "frequent"))
    _release(spark, paths[-1])
    return levels, totals


def _scored(level: DataFrame, length: int) -> DataFrame:
    """Adds ``cut``: score, k, l and r of the cut that scores lowest."""
    a = "cast(n as decimal(38,0))"
    cuts = []
    for k in range(1, length):
        left, right = f"heads[{k - 1}]", f"tails[{length - k - 1}]"
        score = f"1000000 * {a} * {a} div (cast({left} as decimal(38,0)) * {right})"
        cuts.append(f"struct({score} as score, {k} as k, {left} as l, {right} as r)")
    return level.withColumn("cut", F.expr(f"array_min(array({', '.join(cuts)}))"))


def collocations(
    docs: DataFrame,
    max_words: int = MAX_WORDS,
    least: int = LEAST,
    top: int = TOP,
    inside: int = 50,
) -> DataFrame:
    """The ``top`` phrases of each ``lang``: lang, rank, phrase, a, l, r, n, score.

    A phrase that lies in a longer one at least ``inside`` percent as frequent is
    left out.  It is enough to look at phrases one word longer: those inside
    of a still longer one are at least as frequent.
    """
    levels, totals = frequent_phrases(docs, max_words, least)
    found = []
    for length, level in enumerate(levels[1:], 2):
        scored = _scored(level, length)
        if length < max_words:
            around = levels[length].select(F.explode(F.array("a", "b")).alias("id"), F.col("n").alias("_n"))
            around = around.groupBy("id").agg(F.max("_n").alias("_around"))
            covered = F.coalesce(100 * F.col("_around") >= inside * F.col("n"), F.lit(False))
            scored = scored.join(around, "id", "left").where(~covered)
        found.append(
            scored.select(
                "lang", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"), "cut.l", "cut.r", "cut.score"
            )
        )
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = candidates.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    ranked = join_lookup(ranked, totals.withColumnRenamed("total", "n"), "lang")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
