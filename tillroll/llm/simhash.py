"""SimHash fingerprints and their near duplicates, found with BK-trees.

Fingerprints that differ in at most ``RADIUS`` = 2 bits are linked, and a
component is whatever links join.  The 64 bits are cut into three blocks; of
two linked fingerprints at least one block is equal, and of the other two
blocks, cut into three again, at least one part is equal too.  Each distinct
fingerprint therefore goes to nine shards, keyed by the about 35 bits that
have to be equal, and meets every fingerprint it may be linked with.  A shard
is small however many fingerprints there are.  In each shard a BK-tree is
grown: a child hangs from its parent by their Hamming distance, and a search
follows only edges within the radius of the distance just measured.  A shard
returns one link per fingerprint to its group in the shard, not all pairs.
Components over all shards come from rounds of star contraction, each stored
in the shared folder.

The trees are not broadcast: together they hold all fingerprints and would
outgrow any task, so each is grown where its shard lies.

Edge cases: null and empty texts have fingerprint zero and are linked like any
other; texts of fewer than three words have their whole sequence as their only
shingle; repeated rows share fingerprint and component; a null id takes part
but is never a component's id unless the component has no other (then null);
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.llm.batches import aside, slices
from tillroll.operators.joins import join_lookup
from tillroll.session import stage

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
BLOCKS = ((0, 22), (22, 43), (43, 64))
FLUSH_SHINGLES = 1 << 16


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of each run of ``words`` words, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return []
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(parts), SEED)]
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = (np.cumsum(lengths + 1) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[: len(parts) - words]]]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])]


def _bit_counts(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit set, lowest first."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), FLUSH_SHINGLES):
        part = np.array(hashes[i : i + FLUSH_SHINGLES], "<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return counts


def simhash(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint, unsigned."""
    hashes = shingle_hashes(text, words)
    bits = (_bit_counts(hashes) * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): each document's fingerprint as a signed long."""

    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = np.array([simhash(t, words) for t in part.column("text").to_pylist()], "<u8")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(found.view(np.int64))], ["doc_id", "fp"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(mapped, "doc_id long, fp long")


class BKTree:
    """Children keyed by the integer Hamming distance to their parent."""

    def __init__(self, root: int) -> None:
        self.children: dict[int, dict[int, int]] = {root: {}}
        self.root = root

    def near(self, value: int, radius: int) -> list[int]:
        """Members at most ``radius`` bits from ``value``."""
        found, open_nodes, children = [], [self.root], self.children
        while open_nodes:
            node = open_nodes.pop()
            distance = (node ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            below = children[node]
            for edge in range(max(distance - radius, 1), distance + radius + 1):
                if edge in below:
                    open_nodes.append(below[edge])
        return found

    def add(self, value: int) -> None:
        """Insert a value that is not a member yet."""
        node = self.root
        while True:
            distance = (node ^ value).bit_count()
            if distance not in self.children[node]:
                self.children[node][distance] = value
                self.children[value] = {}
                return
            node = self.children[node][distance]


def _root(parent: dict[int, int], node: int) -> int:
    while parent[node] != node:
        parent[node] = parent[parent[node]]
        node = parent[node]
    return node


def shard_links(members: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A link from each member to the least of its group, if that is another."""
    tree = BKTree(members[0])
    parent = {m: m for m in members}
    for value in members[1:]:
        for other in tree.near(value, radius):
            a, b = _root(parent, value), _root(parent, other)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(value)
    return [(m, r) for m in members if (r := _root(parent, m)) != m]


def _masks() -> list[int]:
    """Bits that have to be equal in each of the nine kinds of shard."""
    masks = []
    for low, high in BLOCKS:
        block = (1 << high) - (1 << low)
        rest = [bit for bit in range(64) if not low <= bit < high]
        third = -(-len(rest) // 3)
        for i in range(0, len(rest), third):
            masks.append(block | sum(1 << bit for bit in rest[i : i + third]))
    return masks


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints that give the components.

    ``fps`` has the distinct ``fp``.  Exact for a radius of at most two.
    """
    if not 0 <= radius <= len(BLOCKS) - 1:
        raise ValueError("the shards find links of at most two bits")
    keys = F.array(
        *[
            F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
            for i, m in enumerate(_masks())
        ]
    )
    placed = fps.select("fp", F.inline(keys))
    together = Window.partitionBy("mask", "key")
    met = placed.withColumn("_n", F.count("*").over(together)).where("_n > 1").drop("_n")

    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, members, found = None, [], []
        unsigned = (1 << 64) - 1

        def close() -> None:
            if len(members) > 1:
                found.extend((_signed(a), _signed(b)) for a, b in shard_links(members, radius))

        def rows() -> pa.RecordBatch:
            a, b = zip(*found) if found else ((), ())
            found.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("mask", "key", "fp")]
            for mask, key, fp in zip(*columns):
                if (mask, key) != shard:
                    close()
                    shard, members = (mask, key), []
                members.append(fp & unsigned)
            if found:
                yield rows()
        close()
        if found:
            yield rows()

    # The window leaves each shard's rows next to each other in one partition.
    return met.mapInArrow(mapped, "a long, b long").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def contract(edges: DataFrame) -> DataFrame:
    """(a, root) for every node that has a link; the root is its component's least node.

    Each round hangs the larger neighbours of a node, then the smaller ones,
    on the least node next to it, until every component is one star.
    """
    edges = stage(edges, "links")
    state = _state(edges)
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u")
        edges = stage(
            small.select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(low.select("u", "m"))
            .where("a <> b")
            .distinct(),
            "links",
        )
        before, state = state, _state(edges)
        if state == before:
            return edges.toDF("a", "root")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, root, component_id) of each document, all texts fingerprinted whole.

    ``root`` is the component's least fingerprint.
    """
    prints = stage(fingerprints(docs, words), "fingerprints")
    return prints.join(_classes(prints, radius), "fp").select("doc_id", "fp", "root", "component_id")


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    stars = contract(links(distinct.select("fp"), radius))
    rooted = distinct.join(stars.withColumnRenamed("a", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.select("fp", "root").join(named, "root").select("fp", "root", "component_id")


def one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: the one with its id, all columns kept.

    Rows without an id of their own (null or repeated) are told apart by their
    fingerprints; any one of a component's rows with the least id stays.
    """
    used, back = aside(docs, ("doc_id", "text"))
    classes = stage(near_duplicates(used, words, radius), "components")
    by_id = classes.where("doc_id is not null").groupBy("doc_id").agg(
        F.count("*").alias("_n"), F.min("component_id").alias("_first")
    )
    verdicts = stage(
        by_id.where("_n > 1 or _first <> doc_id").select("doc_id", (F.col("_n") > 1).alias("_odd")),
        "verdicts",
    )
    judged = join_lookup(used, verdicts, "doc_id", "left")
    kept = judged.where("doc_id is not null and _odd is null").drop("_odd")
    if not classes.where("doc_id is null").isEmpty() or not verdicts.where("_odd").isEmpty():
        rows = judged.where("doc_id is null or _odd").drop("_odd")
        marked = rows.withColumn("_text", F.xxhash64("text"))
        keys = marked.select("doc_id", "text", "_text").distinct()
        prints = fingerprints(keys.select(F.col("_text").alias("doc_id"), "text"), words)
        prints = prints.distinct().toDF("_text", "fp")
        named = classes.select("fp", "root", "component_id").distinct()
        odd = marked.join(prints, "_text").join(named, "fp")
        odd = odd.where("component_id is null or component_id = doc_id")
        kept = kept.unionByName(odd.dropDuplicates(["root"]).select(*kept.columns))
    return back(kept)
