"""Phrase mining against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tillroll.llm import phrases


def brute_force(docs, max_words=3, least=10, top=2000, inside=50):
    """docs: (text, lang) pairs."""
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for size in range(1, max_words + 1):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    frequent = {k: n for k, n in counts.items() if len(k[1]) > 1 and n >= least}
    covered = set()
    for (lang, words), n in frequent.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                part = lang, words[i : i + size]
                if 100 * n >= inside * counts[part]:
                    covered.add(part)
    rows = []
    for (lang, words), a in frequent.items():
        if (lang, words) in covered:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        rows.append((lang, " ".join(words), a, left, right, totals[lang], score))
    rows.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranked, rank = [], Counter()
    for lang, phrase, a, left, right, n, score in rows:
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.append((lang, rank[lang], phrase, a, left, right, n, score))
    return ranked


def mined(spark, docs, **options):
    frame = spark.createDataFrame(docs, "text string, lang string")
    return sorted(map(tuple, phrases.collocations(frame, **options).collect()))


def random_docs(seed, n=200):
    pick = random.Random(seed)
    words = ["a", "A", "bé", "c", "the", "Of", "ß", "x-y", "日本", "Ä"]
    seps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\x0b", " ; ", "\xa0", ""]
    return [
        (
            "".join(pick.choice(words) + pick.choice(seps) for _ in range(pick.randint(0, 40))),
            pick.choice(["en", "en", "de", None, "und"]),
        )
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    docs = random_docs(seed)
    expected = brute_force(docs, least=4)
    assert len(expected) > 20
    assert mined(spark, docs, least=4) == expected


def test_longer_phrases_and_few_places(spark):
    docs = random_docs(7)
    for options in ({"max_words": 5, "least": 3}, {"max_words": 2}, {"top": 4, "least": 3, "inside": 90}):
        assert mined(spark, docs, **options) == brute_force(docs, **options)


def test_without_broadcasts(spark, large_lookups):
    docs = random_docs(11)
    assert mined(spark, docs, max_words=4, least=3) == brute_force(docs, max_words=4, least=3)


def test_long_pieces_and_copies(spark):
    # A piece of 50,000 words, frequent words and repeated texts.
    long = " ".join(random.Random(3).choice(["of", "of", "the", "sea"]) for _ in range(50_000))
    docs = [(long, "en"), (long[:999], "en"), *[("of the sea, of the", "en")] * 30, (None, None), ("", "en")]
    assert mined(spark, docs) == brute_force(docs)


def test_words_of_cuts_chunks_at_documents():
    import numpy as np

    texts = [b"", b"A b", b"c", b" .d,e f", b"."]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    words, doc, place = phrases.words_of(data, offsets)
    assert words.to_pylist() == [b"a", b"b", b"c", b"d", b"e", b"f"]
    assert doc.tolist() == [1, 1, 2, 3, 3, 3]
    assert place.tolist() == [0, 1, 3, 5, 7, 8]


def test_scores_past_64_bits(spark):
    rows = [(10**14 + 7, [10**14 + 9], [10**14 + 11]), (2**40, [2**41 + 1], [2**40 + 5]), (3, [10**9], [10**9])]
    level = spark.createDataFrame(rows, "n long, heads array<long>, tails array<long>")
    found = phrases._scored(level, 2).select("n", "cut.*").collect()
    assert {(r.n, r.score) for r in found} == {(a, 10**6 * a * a // (h[0] * t[0])) for a, h, t in rows}


def test_odd_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(None, None), ("", "en"), ("one", "en")]) == []
    frame = spark.createDataFrame([("of the", "en", 1, 2)] * 10, "text string, lang string, n int, phrase int")
    assert [tuple(r) for r in phrases.collocations(frame).collect()] == [
        ("en", 1, "of the", 10, 10, 10, 20, 1000000)
    ]


def test_relation_is_sorted_and_joined_without_shuffle(spark, tmp_path):
    docs = spark.createDataFrame(random_docs(1), "text string, lang string").coalesce(1)
    words = phrases.word_relation(docs, f"{tmp_path}/words")
    for row in words.collect():
        assert (phrases._unpacked(row.gaps)[1:] > 0).all()
    counts = phrases._counted(words, "lang", "word").withColumn("id", F.monotonically_increasing_id())
    pairs = phrases.next_relation(words, counts, ("lang", "word"), False, f"{tmp_path}/pairs")
    assert pairs.rdd.getNumPartitions() == words.rdd.getNumPartitions() == 1
    assert sum(sum(r.n) for r in pairs.collect()) > 1000


def test_a_row_group_holds_few_chunks(spark, tmp_path):
    """A reader holds a whole row group of a relation, arrays and all."""
    pick = random.Random(8)
    texts = [" ".join(f"w{pick.randrange(90_000)}" for _ in range(180_000)) for _ in range(9)]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").coalesce(1)
    phrases.word_relation(docs, str(tmp_path / "words"))
    groups = []
    for file in (tmp_path / "words").glob("*.parquet"):
        about = pq.ParquetFile(file).metadata
        groups += [about.row_group(i) for i in range(about.num_row_groups)]
    assert sum(g.num_rows for g in groups) >= 5
    assert all(g.num_rows == 1 or g.total_byte_size < 2 * phrases.ROW_GROUP_BYTES for g in groups)
    assert max(g.num_rows for g in groups) < 5


def test_pairs_are_counted_over_many_buckets(spark, monkeypatch):
    """The same counts, however few entries a task holds and a bucket gets."""
    monkeypatch.setattr(phrases, "SENT_ENTRIES", 50)
    monkeypatch.setattr(phrases, "BUCKET_ENTRIES", 20)
    docs = random_docs(5)
    assert mined(spark, docs, least=3) == brute_force(docs, least=3)


def test_mixing_is_one_to_one():
    for bits in (1, 2, 7, 12):
        numbers = np.arange(1 << bits, dtype=np.uint64)
        mixed = phrases._Mixer(bits).mix(numbers)
        assert sorted(mixed.tolist()) == numbers.tolist()
        assert (phrases._Mixer(bits).unmix(mixed) == numbers).all()
    large = np.array([0, 1, (1 << 61) - 1, 12345678901234567], np.uint64)
    mixer = phrases._Mixer(61)
    assert (mixer.unmix(mixer.mix(large)) == large).all()
    for numbers in ([0], [0, 255, 256], [1 << 40, 3]):
        numbers = np.array(numbers, np.uint64)
        assert (phrases._received(phrases._sent(numbers), len(numbers)) == numbers).all()


def test_counts_of_pairs_are_added_over_chunks(spark):
    pick = random.Random(4)
    a, b = ([pick.randrange(30_000) for _ in range(100_000)] for _ in range(2))
    pairs = Counter(zip(a, b))
    row = (0, None, None, [p[0] for p in pairs], [p[1] for p in pairs], list(pairs.values()))
    relation = spark.createDataFrame([row, row], phrases.PAIR_SCHEMA).coalesce(1)
    # As rows they took over 12 bytes each in a compressed shuffle.
    sent = phrases._sent_pairs(relation, 30_000)[0]
    octets = sent.agg(F.sum(F.octet_length("steps") + F.octet_length("n"))).first()[0]
    assert octets < 5 * len(pairs)
    counted = phrases._pair_counts(relation, 30_000, 4)
    found = {(r.a, r.b): r.n for r in counted.collect()}
    assert found == {p: 2 * n for p, n in pairs.items() if n >= 2}


def test_ids_have_no_gaps(spark):
    frame = spark.range(1000).repartition(7).where("id % 7 < 3").withColumnRenamed("id", "x")
    ids = sorted(r.id for r in phrases._numbered(frame, "some").collect())
    assert ids == list(range(len(ids))) and len(ids) > 400
