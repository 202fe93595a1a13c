"""Benchmark decontamination by latent semantic retrieval.

1. Passages of ``WINDOW`` words are cut from all texts.  One pass counts in how
   many of them each term occurs, by 2**20 hash buckets, which fixes the
   inverse document frequencies.
2. A second pass gives a randomised SVD of the TF-IDF passages over the terms
   of the benchmark: the passages' product with a random matrix is summed in a
   tree of tasks, and one Nystroem step gives the right singular vectors.  The
   benchmark items, those longer than a passage in even pieces, are rows of the
   matrix as well, weighted like the corpus as a whole, so that its leading
   vectors can tell the items apart.
3. A third pass cuts overlapping passages and compares each with all pieces by
   the cosine of their latent vectors, relative to the length of the whole
   TF-IDF vectors.  Passages whose benchmark terms are too light to reach
   ``COSINE``, even if each stood there ``REPEATS`` times, are left out first.
4. Candidates are checked where they are found: passages near one another are
   joined up to the length of the item, and with the item's length and a quarter
   (a window's at least) on either side make a span that holds any copy of the
   item.  The longest common subsequence of item and span must hold
   ``LCS_SHARE`` of the item's words, and that of the item's answer, its last
   sentence, ``ANSWER_SHARE`` of the answer's.
5. An item of at most ``SHORT`` words fills less than half of a passage and may
   stay below ``COSINE`` among heavier words.  It is sought by its rarest words
   as well: a match lacks so few of the item's words that at least ``SEEDS`` of
   those must be there.  Where as many stand within twice the item's length,
   the same check is made, on the words a match of that length could take up.

Items are taken in blocks of ``ITEM_BLOCK`` pieces (more only if one item has
more), each with its own latent space, so what is broadcast is bounded by the
block and the hash buckets.

Words are runs of letters, marks and digits; A-Z and capitals of Latin-1 are
lowered.  In scripts without blanks each character is a word, and so is each
symbol outside of ASCII.  An item with fewer than ``LEAST_WORDS`` words must
stand word for word.  Two parameters say which of these are left out: items with
fewer than ``least_words`` words (single words), and, unless ``common``, items
all of whose words are so common that they carry no weight ("of the"): a share
of the passages, but ``COMMON_LEAST`` passages at least, which counts in corpora
of under 1000 passages.  ``least_words=1, common=True`` seeks all.

Edge cases: null and empty texts match nothing; repeated rows and
repeated items give repeated pairs; a null id is returned as null; an empty
table on either side gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.batches import row_chunks, share, text_bytes

WINDOW = 64
TERM_BITS = 20
COMMON_SHARE = 0.02  # terms in more of the passages carry no weight
COMMON_LEAST = 20
KEPT_TERMS = 5  # a piece with fewer weighted terms keeps all of its own
ITEM_BLOCK = 256
EXTRA_RANK = 64
ITEM_KEPT = 0.95  # of an item's length that the latent space has to hold
DOUBLINGS = 20
COSINE = 0.25
REPEATS = 8  # a word repeated in a passage is foreseen up to so many times
LCS_SHARE = 0.8
ANSWER_SHARE = 0.5
SHORT = 32
SEEDS = 3
LEAST_WORDS = 5
LEAST_SOUGHT = 2
SEED = 42
CHUNK = 1 << 20

MIX = 0x9E3779B97F4A7C15
BASE = 0x100000001B3
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
# What a byte adds to the hash of its word; a capital adds what its small letter does.
VALUES = np.arange(1, 257, dtype=np.uint64)
VALUES[65:91] += np.uint64(32)
VALUES[:128][~IS_WORD[:128]] = 0
BLOCK = 512  # rows of floats summed at once, few enough to stay in the cache

# Scripts that are written without blanks, and marks that end a sentence.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF),
    (0x3005, 0x3007), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
    (0x4E00, 0xA4CF), (0xA980, 0xA9DF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F),
    (0x1B000, 0x1B16F), (0x20000, 0x323AF),
)
SENTENCE_END = re.compile(r"(?<=[.!?؟])\s+|(?<=[。！？｡।])\s*")
SEPARATOR, IN_WORD, WORD = range(3)


def _kinds() -> np.ndarray:
    """What each code point is: between words, part of one or a word of its own."""
    kinds = np.full(0x110000, IN_WORD, np.uint8)
    for point in range(128, 0x20000):
        category = unicodedata.category(chr(point))
        if category[0] in "PZ" or category == "Cc" or point in (0x200B, 0x2060, 0xFEFF):
            kinds[point] = SEPARATOR
        elif category[0] == "S":
            kinds[point] = WORD
    for first, last in UNSPACED:
        part = kinds[first : last + 1]
        part[part == IN_WORD] = WORD
    return kinds


KINDS = _kinds()


class Words(NamedTuple):
    """Hashes of all words of some texts, and where each text's words start."""

    hashes: np.ndarray
    starts: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    if not len(data):
        return Words(np.empty(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = IS_WORD[data]
    values = VALUES[data]
    alone, after = _beyond_ascii(data, inside, values)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[alone] = True
    first[after] = inside[after]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]  # a word doesn't go on in the next text
    begins = np.flatnonzero(first)
    if not len(begins):
        return Words(np.empty(0, np.uint64), np.zeros(len(offsets), np.int64))
    # A byte counts by its place in the data; dividing by that of the word's start leaves the word's own hash.
    powers, inverses = _powers(max(len(data), CHUNK))
    values *= powers[: len(data)]
    hashes = np.add.reduceat(values, begins) * inverses[begins]
    hashes *= np.uint64(MIX)
    hashes ^= hashes >> np.uint64(29)
    return Words(hashes * np.uint64(MIX), np.searchsorted(begins, offsets))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``BASE`` modulo 2**64, from 1, and their inverses, times ``BASE``."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0], down[0] = 1, BASE
    return np.cumprod(up, out=up), np.cumprod(down, out=down)


def _beyond_ascii(data: np.ndarray, inside: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks the bytes of characters that words hold; where words of one character start and end.

    Lowers the capitals in ``values`` and takes out the bytes that no word holds.
    """
    high = np.flatnonzero(data >= 0x80)
    if not len(high):
        return high, high
    lead = high[data[high] >= 0xC0]
    head = data[lead]
    second = lead[head == 0xC3] + 1
    second = second[second < len(data)]
    letter = data[second]
    values[second[(letter >= 0x80) & (letter <= 0x9E) & (letter != 0x97)]] += np.uint64(32)
    sizes = 2 + (head >= 0xE0) + (head >= 0xF0)
    points = (head & (0xFF >> (sizes + 1))).astype(np.int64)
    rest = np.minimum(lead[:, None] + np.arange(1, 4), len(data) - 1)
    for i in range(3):
        more = sizes > i + 1
        points[more] = points[more] << 6 | data[rest[more, i]] & 0x3F
    kinds = KINDS[np.minimum(points, len(KINDS) - 1)]
    inside[lead] = kinds != SEPARATOR
    for i in range(3):
        more = sizes > i + 1
        inside[rest[more, i]] = kinds[more] != SEPARATOR
    values[high[~inside[high]]] = 0
    alone, ends = lead[kinds == WORD], (lead + sizes)[kinds == WORD]
    return alone, ends[ends < len(data)]


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, Words]]:
    """Batch, first row and words of each run of rows."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for start, end in row_chunks(offsets, CHUNK):
            part = offsets[start : end + 1]
            yield batch, start, words_of(data[part[0] : part[-1]], part - part[0])


def _passages(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The numbers of the passages that the words ``at`` are in; passages don't overlap here."""
    counts = -(-np.diff(starts) // WINDOW)
    base = np.cumsum(counts) - counts
    row = np.searchsorted(starts, at, "right") - 1
    return base[row] + (at - starts[row]) // WINDOW


def _run_starts(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def _row_sums(table: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Sums of the table's ``rows`` from each start to the next, some starts at a time."""
    ends = np.append(starts[1:], len(rows))
    i = 0
    while i < len(starts):
        # About BLOCK rows, one sum at least.
        j = max(int(np.searchsorted(ends, starts[i] + BLOCK, "right")), i + 1)
        part = table[rows[starts[i] : ends[j - 1]]]
        yield slice(i, j), np.add.reduceat(part, starts[i:j] - starts[i], axis=0)
        i = j


def _summed(docs: DataFrame, partial: Callable[[Iterable[pa.RecordBatch]], np.ndarray]) -> np.ndarray | None:
    """Sum over all partitions of an array of fixed size, added up in a tree of tasks."""

    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = partial(batches)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.large_binary())], ["part"])

    parts = docs.select(F.col("text").cast("string")).mapInArrow(mapped, "part binary").rdd
    arrays = parts.map(lambda row: np.frombuffer(row[0]))
    return arrays.treeAggregate(None, _plus, _plus, depth=3)


def _plus(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
    return b if a is None else a if b is None else a + b


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Passages that hold a term of each bucket, and passages in all."""

    def partial(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((1 << TERM_BITS) + 1)
        for _, _, words in _chunks(batches):
            if len(words.hashes):
                passage = _passages(words.starts, np.arange(len(words.hashes)))
                keys = np.sort(passage << TERM_BITS | buckets(words.hashes))
                once = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
                total[:-1] += np.bincount(once & ((1 << TERM_BITS) - 1), minlength=1 << TERM_BITS)
                total[-1] += passage[-1] + 1
        return total

    total = _summed(docs, partial)
    return (np.zeros(1 << TERM_BITS), 0) if total is None else (total[:-1], int(total[-1]))


class Item(NamedTuple):
    item_id: int | None
    words: list[int]
    answer: list[int]


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return words_of(data, np.array([0, len(data)])).hashes


def _is_common(df: np.ndarray, passages: int) -> np.ndarray:
    """Whether the terms of a bucket carry no weight."""
    return df > max(COMMON_SHARE * passages, COMMON_LEAST)


def read_items(
    benchmark: DataFrame, is_common: np.ndarray, least_words: int = LEAST_SOUGHT, common: bool = False
) -> Iterator[list[Item]]:
    """The items to seek, in blocks; the driver holds one block at a time."""
    block: list[Item] = []
    size = 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = _hashes(row.text or "").tolist()
        plain = is_common[buckets(np.array(words, np.uint64))].all()
        if len(words) >= LEAST_WORDS or len(words) >= max(least_words, 1) and (common or not plain):
            sentences = [s for s in SENTENCE_END.split(row.text.strip()) if len(_hashes(s))]
            item = Item(row.item_id, words, _hashes(sentences[-1]).tolist())
            if block and size + len(pieces(item)) > ITEM_BLOCK:
                yield block
                block, size = [], 0
            block.append(item)
            size += len(pieces(item))
    if block:
        yield block


def pieces(item: Item) -> list[list[int]]:
    """The item's words in even pieces of at most a passage."""
    count = -(-len(item.words) // WINDOW)
    cuts = [len(item.words) * i // count for i in range(count + 1)]
    return [item.words[a:b] for a, b in zip(cuts, cuts[1:])]


class Seeds(NamedTuple):
    """The rarest words of a block's short items."""

    terms: np.ndarray  # sorted hashes
    is_term: np.ndarray  # by bucket
    wanted: list[tuple[int, np.ndarray, int]]  # item, places in terms, words that must be there


class Space(NamedTuple):
    """Latent space of a block of items; all that a task needs to search."""

    weights: np.ndarray  # by bucket
    terms: np.ndarray  # sorted hashes of the block's weighted terms
    is_term: np.ndarray  # by bucket
    likeness: np.ndarray  # terms x pieces: a word's share in the product of latent vectors, over the piece's length
    owner: np.ndarray  # the item of each piece
    items: list[Item]
    seeds: Seeds
    tiny: dict[int, dict[int, list[int]]]  # size, hash of the words in a row, items


def _rows_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` words in a row."""
    result = hashes[: len(hashes) - size + 1]
    for i in range(1, size):
        result = result * np.uint64(MIX) ^ hashes[i : len(hashes) - size + 1 + i]
    return result


def _tiny(items: list[Item]) -> dict[int, dict[int, list[int]]]:
    found: dict[int, dict[int, list[int]]] = {}
    for j, item in enumerate(items):
        size = len(item.words)
        if size < LEAST_WORDS:
            whole = int(_rows_of(np.array(item.words, np.uint64), size)[0])
            found.setdefault(size, {}).setdefault(whole, []).append(j)
    return found


def _seeds(items: list[Item], df: np.ndarray) -> Seeds:
    chosen = []
    for j, item in enumerate(items):
        size = len(item.words)
        if LEAST_WORDS <= size <= SHORT:
            lacking = size - math.ceil(LCS_SHARE * size)
            least = min(SEEDS, size - lacking)
            words = np.array(item.words, np.uint64)
            rarest = np.argsort(df[buckets(words)], kind="stable")[: lacking + least]
            chosen.append((j, np.unique(words[rarest]), least))
    terms = np.unique(np.concatenate([np.empty(0, np.uint64), *(words for _, words, _ in chosen)]))
    is_term = np.zeros(1 << TERM_BITS, bool)
    is_term[buckets(terms)] = True
    return Seeds(terms, is_term, [(j, np.searchsorted(terms, words), least) for j, words, least in chosen])


def _term_places(hashes: np.ndarray, terms: np.ndarray, is_term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are terms, and the terms' numbers."""
    maybe = np.flatnonzero(is_term[buckets(hashes)])
    place = np.searchsorted(terms, hashes[maybe])
    place[place == len(terms)] = 0
    hit = terms[place] == hashes[maybe]
    return maybe[hit], place[hit]


def _weights(df: np.ndarray, passages: int, parts: list[list[int]]) -> np.ndarray:
    weights = np.log1p(passages / np.maximum(df, 1))
    common = _is_common(df, passages)
    for part in parts:
        own = buckets(np.array(part, np.uint64))
        if len(np.unique(own[~common[own]])) < KEPT_TERMS:
            common[own] = False
    weights[common] = 0
    return weights.astype(np.float32)


def _nystroem(random: np.ndarray, product: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of a positive matrix, from its product with a random one."""
    shift = np.sqrt(len(product)) * np.finfo(float).eps * np.linalg.norm(product) + 1e-12
    shifted = product + shift * random
    small = random.T @ shifted
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    kept = values > values[-1] * 1e-12
    root = shifted @ (vectors[:, kept] / np.sqrt(values[kept]))
    return np.linalg.svd(root, full_matrices=False)[0][:, :rank]


def fit_space(docs: DataFrame, items: list[Item], df: np.ndarray, passages: int) -> Space | None:
    """Randomised SVD of all passages and the items, over the items' terms."""
    parts = [part for item in items for part in pieces(item)]
    owner = np.repeat(np.arange(len(items)), [len(pieces(item)) for item in items])
    weights = _weights(df, passages, parts)
    every = np.unique(np.concatenate([np.array(part, np.uint64) for part in parts]))
    terms = every[weights[buckets(every)] > 0]
    if not len(terms):
        return None
    is_term = np.zeros(1 << TERM_BITS, bool)
    is_term[buckets(terms)] = True
    rank = min(len(parts) + EXTRA_RANK, len(terms))
    columns = min(rank + 16, len(terms))
    random = np.random.default_rng(SEED).standard_normal((len(terms), columns))
    rows = np.zeros((len(parts), len(terms)))
    for i, part in enumerate(parts):
        hashes = np.array(part, np.uint64)
        at, place = _term_places(hashes, terms, is_term)
        np.add.at(rows[i], place, weights[buckets(hashes[at])])
    own = weights[buckets(terms)]
    weighted = random.astype(np.float32) * own[:, None]
    shared = docs.sparkSession.sparkContext.broadcast((own, terms, is_term, weighted))

    def partial(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        own, terms, is_term, weighted = shared.value
        total = np.zeros((len(terms), weighted.shape[1] + 1))  # the last column: the rows' energy
        for _, _, words in _chunks(batches):
            at, place = _term_places(words.hashes, terms, is_term)
            if not len(at):
                continue
            passage = _passages(words.starts, at)
            first = _run_starts(passage)
            projected = np.empty((len(first), weighted.shape[1]), np.float32)
            for some, sums in _row_sums(weighted, place, first):
                projected[some] = sums
            row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
            by_term = np.argsort(place, kind="stable")
            sorted_places = place[by_term]
            runs = _run_starts(sorted_places)
            for some, sums in _row_sums(projected, row[by_term], runs):
                total[sorted_places[runs[some]], :-1] += sums
            total[0, -1] += float((own[place] ** 2).sum())
        total[:, :-1] *= own[:, None]
        return total.ravel()

    product = _summed(docs, partial)
    shared.destroy()
    if product is None:
        return None
    product = product.reshape(len(terms), columns + 1)
    lengths = np.linalg.norm(rows, axis=1)
    units = rows[lengths > 0] / lengths[lengths > 0, None]
    scale = max(product[0, -1], 1.0) / max(len(units), 1)  # the items weigh as much as the corpus
    for _ in range(DOUBLINGS):
        basis = _nystroem(random, product[:, :-1] + scale * (units.T @ (units @ random)), rank)
        if np.linalg.norm(units @ basis, axis=1).min(initial=1.0) >= ITEM_KEPT:
            break
        scale *= 4
    latent = (rows @ basis / np.maximum(lengths, 1e-9)[:, None]).T
    likeness = (own[:, None] * (basis @ latent)).astype(np.float32)
    return Space(weights, terms, is_term, likeness, owner, items, _seeds(items, df), _tiny(items))


def lcs_length(item: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence, by rows of bits."""
    masks: dict[int, int] = {}
    for i, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << i
    full = row = (1 << len(item)) - 1
    for word in words:
        if mask := masks.get(word):
            both = row & mask
            row = ((row + both) | (row - both)) & full
    return len(item) - row.bit_count()


def _search(space: Space, words: Words) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item, cosine, lcs share, answer share) of each match in a run of rows."""
    if len(words.hashes):
        found = {match[:2]: match for match in _search_short(space, words)}
        found |= {match[:2]: match for match in _search_passages(space, words)}
        found |= {match[:2]: match for match in _search_tiny(space, words)}
        yield from found.values()


def _search_short(space: Space, words: Words) -> Iterator[tuple[int, int, float, float, float]]:
    """The matches of short items, found by their rarest words."""
    hashes, starts = words
    terms, is_term, wanted = space.seeds
    if not len(terms):
        return
    at, place = _term_places(hashes, terms, is_term)
    by_term = np.argsort(place, kind="stable")
    at = at[by_term]
    cuts = np.searchsorted(place[by_term], np.arange(len(terms) + 1))
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for j, places, least in wanted:
        item = space.items[j]
        reach = 2 * len(item.words)
        near = np.sort(np.concatenate([at[cuts[t] : cuts[t + 1]] for t in places]))
        first, last = near[: len(near) - least + 1], near[least - 1 :]
        close = (last - first < reach) & (row[first] == row[last])
        matched: dict[int, tuple[float, float, float]] = {}
        for a, b in zip(first[close].tolist(), last[close].tolist()):
            r = int(row[a])
            around = hashes[max(b - reach + 1, starts[r]) : min(a + reach, starts[r + 1])]
            shares = _shares(item, around)
            if shares and shares > matched.get(r, (0.0,))[-2:]:
                matched[r] = (_cosine(space.weights, item, around), *shares)
        for r, match in matched.items():
            yield r, j, *match


def _search_tiny(space: Space, words: Words) -> Iterator[tuple[int, int, float, float, float]]:
    """The matches of items of fewer than ``LEAST_WORDS`` words, word for word."""
    hashes, starts = words
    for size, items in space.tiny.items():
        wanted = np.sort(np.array(list(items), np.uint64))
        rows = _rows_of(hashes, size) if len(hashes) >= size else hashes[:0]
        place = np.minimum(np.searchsorted(wanted, rows), len(wanted) - 1)
        at = np.flatnonzero(wanted[place] == rows)
        row = np.searchsorted(starts, at, "right") - 1
        inside = at + size <= starts[row + 1]
        for r, a in zip(row[inside].tolist(), at[inside].tolist()):
            for j in items[int(rows[a])]:
                yield r, j, 1.0, 1.0, 1.0


def _cosine(weights: np.ndarray, item: Item, around: np.ndarray) -> float:
    """The cosine of the TF-IDF vectors of an item and a span."""
    words, numbers = np.unique(np.concatenate([np.array(item.words, np.uint64), around]), return_inverse=True)
    weight = weights[buckets(words)].astype(float)
    a = np.bincount(numbers[: len(item.words)], minlength=len(words)) * weight
    b = np.bincount(numbers[len(item.words) :], minlength=len(words)) * weight
    return min(float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-9)), 1.0)


def _search_passages(space: Space, words: Words) -> Iterator[tuple[int, int, float, float, float]]:
    """The matches found by the latent vectors of passages."""
    step = WINDOW // 2
    hashes, starts = words
    weight = space.weights[buckets(hashes)]
    squares = np.concatenate([[0.0], np.cumsum(weight.astype(float) ** 2)])
    at, place = _term_places(hashes, space.terms, space.is_term)
    ours = np.zeros(len(hashes))
    ours[at] = weight[at]
    term_squares = np.concatenate([[0.0], np.cumsum(ours**2)])
    # Passages start every half window; the last one reaches the end.
    lengths = np.diff(starts)
    halves = -(-lengths // step)
    first_half = np.cumsum(halves) - halves
    counts = np.where(lengths > 0, np.maximum(halves - 1, 1), 0)
    row = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = starts[row] + step * number
    end = np.minimum(begin + WINDOW, starts[row + 1])
    length = squares[end] - squares[begin]
    heavy = (term_squares[end] - term_squares[begin]) >= COSINE**2 / REPEATS * np.maximum(length, 1e-9)
    row, number, begin, end, length = row[heavy], number[heavy], begin[heavy], end[heavy], length[heavy]
    if not len(row):
        return
    low, middle, high = (np.searchsorted(at, a) for a in (begin, np.minimum(begin + step, end), end))
    half = first_half[row] + number
    best: dict[tuple[int, int], float] = {}
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i in range(0, len(row), BLOCK):
        some = slice(i, i + BLOCK)
        # A passage is two halves, which its neighbours share; those that hold no term add nothing.
        numbers, which = np.unique(np.concatenate([half[some], half[some] + 1]), return_index=True)
        froms = np.concatenate([low[some], middle[some]])[which]
        sizes = np.concatenate([middle[some], high[some]])[which] - froms
        numbers, froms, sizes = numbers[sizes > 0], froms[sizes > 0], sizes[sizes > 0]
        inner = np.cumsum(sizes) - sizes
        picks = np.repeat(froms - inner, sizes) + np.arange(sizes.sum())
        sums = np.zeros((len(numbers) + 1, space.likeness.shape[1]), np.float32)
        for part, found in _row_sums(space.likeness, place[picks], inner):
            sums[part] = found
        products = np.zeros((len(half[some]), sums.shape[1]), np.float32)
        for wanted, filled in ((half[some], middle[some] > low[some]), (half[some] + 1, high[some] > middle[some])):
            products += sums[np.where(filled, np.searchsorted(numbers, wanted), len(numbers))]
        # Words that repeat in a passage add up in its vector, and so in its length.
        scale = np.sqrt(np.maximum(length[some], 1e-9))
        cosines = products / scale[:, None]
        for p, j in zip(*np.nonzero(cosines >= COSINE)):
            key = (int(row[i + p]), int(space.owner[j]))
            best[key] = max(best.get(key, 0.0), float(cosines[p, j]))
            spans.setdefault(key, []).append((int(begin[i + p]), int(end[i + p])))
    for (r, j), found in spans.items():
        size = len(space.items[j].words)
        if size < LEAST_WORDS:
            continue
        margin = max(WINDOW, size + size // 4)
        matched = (0.0, 0.0)
        for a, b in _joined(found, max(WINDOW, size)):
            around = hashes[max(a - margin, starts[r]) : min(b + margin, starts[r + 1])]
            matched = max(matched, _shares(space.items[j], around) or matched)
        if matched[0]:
            yield r, j, min(best[r, j], 1.0), *matched


def _joined(spans: list[tuple[int, int]], limit: int) -> Iterator[tuple[int, int]]:
    """Spans, sorted and joined as long as the outcome has at most ``limit`` words."""
    ordered = sorted(set(spans))
    first, last = ordered[0]
    for a, b in ordered[1:]:
        if b - first > limit:
            yield first, last
            first = a
        last = b
    yield first, last


def _shares(item: Item, around: np.ndarray) -> tuple[float, float] | None:
    """The shares of the item's and the answer's words in a span that holds the item."""
    words = around.tolist()
    share = lcs_length(item.words, words) / len(item.words)
    if share < LCS_SHARE:
        return None
    answer = lcs_length(item.answer, words) / len(item.answer)
    return (share, answer) if answer >= ANSWER_SHARE else None


def _matches(docs: DataFrame, space: Space) -> DataFrame:
    shared = share(docs.sparkSession, space)

    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for batch, start, words in _chunks(batches):
            found = list(_search(space, words))
            if found:
                rows, items, *shares = zip(*found)
                ids = batch.column("doc_id").take(pa.array([start + r for r in rows]))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.cast(pa.int64()),
                        pa.array([space.items[j].item_id for j in items], pa.int64()),
                        *[pa.array(s, pa.float64()) for s in shares],
                    ],
                    ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"],
                )

    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(mapped, schema)


def _clean(docs: DataFrame, space: Space) -> DataFrame:
    shared = share(docs.sparkSession, space)

    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for _, start, words in _chunks([batch]):
                keep[[start + match[0] for match in _search(space, words)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(mapped, docs.schema)


def spaces(
    docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_SOUGHT, common: bool = False
) -> Iterator[Space]:
    """The latent space of each block of items, fitted to all documents."""
    df, passages = document_frequencies(docs)
    if passages:
        for items in read_items(benchmark, _is_common(df, passages), least_words, common):
            space = fit_space(docs, items, df, passages)
            if space is not None:
                yield space


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_SOUGHT, common: bool = False
) -> DataFrame:
    """The documents, with all their columns, that hold no item."""
    result = docs
    for space in spaces(docs, benchmark, least_words, common):
        result = _clean(result, space)
    return result


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_SOUGHT, common: bool = False
) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share) of each document with an item in it."""
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"
    result = docs.sparkSession.createDataFrame([], schema)
    for space in spaces(docs, benchmark, least_words, common):
        result = result.union(_matches(docs, space))
    return result
