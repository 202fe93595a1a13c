"""Each operator against brute force or by hand."""

import hashlib
import math
import random
import re
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from odd_tables import WORDS, benchmark, labels, prose  # noqa: E402

from tillroll.llm import (  # noqa: E402
    decontamination,
    html_text,
    mixing,
    perplexity,
    private,
    sharding,
    simhash,
    suffixes,
    syncmers,
    training_order,
)


def documents(spark, texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string")


# 1


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header class="top"><h1>Site</h1></header><nav><a href="/">Home</a></nav>
<div class="cookie-notice">We use cookies, many of them, on every page that you will ever see here.</div>
%s
<aside>More things to read about other topics than this one, at length, if you like to read.</aside>
<div id="comments"><p>First! This comment of a reader is quite long, to look like an article's text.</p></div>
<form><p>Subscribe to whatever we send</p></form><script>if (a < b) { document.write("<p>x</p>") }</script>
<footer>&copy; all rights</footer></body></html>"""
BODY = """<h2>A   title</h2><p>First &amp; <b>long</b>\n paragraph that says a lot of things about the matter.</p>
<div class="ad">Buy now</div><p>Short.</p><!-- <p>no</p> --><p>Third one&nbsp;with a <a href="x">link</a> in it.</p>"""
TEXT = "A title\nFirst & long paragraph that says a lot of things about the matter.\nShort.\nThird one with a link in it."


@pytest.mark.parametrize("wrapped", ["<article>%s</article>", "<main>%s</main>", '<div id="content">%s</div>'])
def test_main_text(wrapped):
    assert html_text.main_text(PAGE % wrapped.replace("%s", BODY)) == TEXT


def test_unclosed_markup():
    assert html_text.main_text("<article><p><b>one<br>two<p>three</article><footer>f") == "one two\nthree"


# 2


def test_lcs():
    pick = random.Random(1)

    def plain(a, b):
        best = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(best[j] + 1 if x == y else max(best[j + 1], row[-1]))
            best = row
        return best[-1]

    for _ in range(200):
        a = [pick.randrange(6) for _ in range(pick.randrange(1, 30))]
        b = [pick.randrange(6) for _ in range(pick.randrange(40))]
        assert decontamination.lcs_length(a, b) == plain(a, b)


def test_words():
    texts = ["Éa, the-Word x", "", "word"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    words = decontamination.words_of(data, np.cumsum([0, *map(len, raw)]))
    assert words.starts.tolist() == [0, 4, 4, 5]
    one = [decontamination._hashes(w)[0] for w in ("éa", "the", "word", "x", "word")]
    assert words.hashes.tolist() == one


def test_contaminated(spark):
    items = [(i, prose(1000 + i, 18) + ". " + prose(2000 + i, 8) + ".") for i in range(12)]
    texts, expected = [], set()
    for i in range(60):
        words = prose(i, 150).split()
        if i % 5 == 0:
            item = items[i // 5][1].split()
            if i % 10 == 0:
                item[4] = "changed"  # a light paraphrase
            words[70:70] = item
            expected.add((i, i // 5))
        texts.append(" ".join(words))
    texts.append(" ".join(items[3][1].split()[:18]))  # an item without its answer
    found = decontamination.contaminated(
        documents(spark, texts), benchmark(spark, [(i, t, 0) for i, t in items])
    ).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected


def invented(seed, words):
    """Prose of a wide vocabulary, so that passages differ."""
    pick = random.Random(seed)
    return [pick.choice(WORDS) if pick.random() < 0.3 else f"w{pick.randrange(3000)}" for _ in range(words)]


@pytest.mark.parametrize("size", [64, 65, 200, 300, 2000])
def test_long_items(spark, size):
    items = [[*invented(10 + i, size - 8), "ends.", *invented(20 + i, 7)] for i in range(3)]
    texts, expected = [], set()
    for i in range(12):
        item, words = items[i % 3], invented(100 + i, 150)
        if i < 3:  # verbatim, at the start of the text
            texts.append(" ".join(item + words))
        elif i < 6:  # lightly paraphrased
            copy = [w if n % 10 != 4 else "changed" for n, w in enumerate(item)]
            copy = [x for n, w in enumerate(copy) for x in ([w, "added"] if n % 12 == 7 else [w])]
            texts.append(" ".join(words[:70] + copy + words[70:]))
        elif i < 9:  # two thirds of the item only
            texts.append(" ".join(words[:70] + item[size // 3 :] + words[70:]))
        else:
            texts.append(" ".join(words))
        if i < 6:
            expected.add((i, i % 3))
    found = decontamination.contaminated(
        documents(spark, texts), benchmark(spark, [(i, " ".join(t), 0) for i, t in enumerate(items)])
    ).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == sorted(expected)


def test_short_items_of_common_words(spark):
    items = [prose(3000 + i, size).split() for i, size in enumerate([5, 5, 6, 6, 8, 8, 10, 12, 15])]
    texts = []
    for i in range(45):
        words = invented(400 + i, 150)
        rare = [w for w in words if w not in WORDS]
        texts.append(" ".join(rare[:40] + items[i % 9] + rare[40:]))
    texts += [" ".join(items[i][: len(items[i]) // 2]) for i in range(9)]
    found = decontamination.contaminated(
        documents(spark, texts), benchmark(spark, [(i, " ".join(t), 0) for i, t in enumerate(items)])
    ).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(i, i % 9) for i in range(45)]
    assert all(0 < r.cosine <= 1 for r in found)


def test_words_take_little_room_and_long_ones_differ():
    """One number a byte for the hashes, not four; bytes 64 places apart count differently."""
    text = " ".join(invented(5, 40_000)).encode()
    data = np.frombuffer(text, np.uint8)
    decontamination.words_of(data, np.array([0, len(data)]))
    tracemalloc.start()
    decontamination.words_of(data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * len(data)
    turned = decontamination._hashes("a" + 63 * "x" + "b  b" + 63 * "x" + "a")
    assert len(set(turned.tolist())) == 2


def test_products_of_halves_are_those_of_whole_passages():
    pick = random.Random(6)
    texts = [[pick.randrange(40) for _ in range(size)] for size in (0, 1, 31, 32, 33, 64, 65, 96, 97, 700, 3)]
    vocabulary = np.sort(decontamination._hashes(" ".join(f"t{i}" for i in range(40))))
    is_term = np.zeros(1 << decontamination.TERM_BITS, bool)
    is_term[decontamination.buckets(vocabulary[:25])] = True
    weights = np.ones(1 << decontamination.TERM_BITS, np.float32)
    likeness = np.random.default_rng(1).standard_normal((25, 7)).astype(np.float32)
    item = decontamination.Item(0, [1] * 5, [1])
    space = decontamination.Space(
        weights, vocabulary[:25], is_term, likeness, np.arange(7), [item] * 7, None, {}
    )
    hashes = np.array([vocabulary[i] for text in texts for i in text], np.uint64)
    words = decontamination.Words(hashes, np.cumsum([0, *map(len, texts)]))
    shares, decontamination._shares = decontamination._shares, lambda *_: (1.0, 1.0)
    try:
        found = {m[:2]: m[2] for m in decontamination._search_passages(space, words)}
    finally:
        decontamination._shares = shares
    expected = {}
    for r, text in enumerate(texts):
        for a in range(0, max(len(text) - 32, 1), 32):
            part = text[a : a + 64]
            inside = [i for i in part if i < 25]
            if inside:
                products = likeness[inside].astype(float).sum(axis=0) / np.sqrt(len(part))
                for j in np.flatnonzero(products >= decontamination.COSINE):
                    expected[r, j] = max(expected.get((r, j), 0.0), min(products[j], 1.0))
    assert found.keys() == expected.keys()
    assert found == pytest.approx(expected, abs=1e-5)


def test_words_of_other_scripts():
    count = lambda text: len(decontamination._hashes(text))
    assert count("水在一百度沸腾。") == 7
    assert count("“Où est‑il ?” — “Là…”") == 4
    assert count("กขค") == 3
    assert count("नमस्ते दुनिया।") == 2
    assert count("한국어 문장") == 2
    assert count("😀 a𠀀b") == 4
    assert (decontamination._hashes("（水）") == decontamination._hashes("水")).all()
    whole, parts = decontamination._hashes("naïve水x"), [decontamination._hashes(w)[0] for w in ("naïve", "水", "x")]
    assert whole.tolist() == parts


def test_items_of_other_scripts_and_of_few_words(spark):
    pick = random.Random(4)
    han = lambda n: "".join(chr(0x4E00 + pick.randrange(2000)) for _ in range(n))
    items = [han(12) + "。" + han(6) + "。", han(100) + "。" + han(20), han(3), "Zebrafish Quokka", "of", "zebrafish okapi ibex"]
    texts = [han(80) + items[0] + han(80), han(200) + items[1] + han(90), han(50) + items[2] + han(50)]
    texts += [prose(1, 80) + " (zebrafish, quokka) " + prose(2, 80), prose(3, 80) + " quokka zebrafish", prose(4, 300)]
    texts += ["the zebrafish", "quokka the"]  # not across texts
    found = decontamination.contaminated(
        documents(spark, texts), benchmark(spark, [(i, t, 0) for i, t in enumerate(items)])
    ).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_items_of_few_words_beside_many_texts(spark):
    texts = [prose(i, 40) for i in range(2000)]
    texts[77] = "alpha beta " + texts[77]
    texts[1500] += " beta alpha"
    items = benchmark(spark, [(0, "Alpha beta", 0), (1, "alpha", 0), (2, "stone river", 0)])
    docs = documents(spark, texts)
    pairs = lambda found: sorted((r.doc_id, r.item_id) for r in found.collect())
    assert pairs(decontamination.contaminated(docs, items)) == [(77, 0)]
    rivers = [(i, 2) for i, t in enumerate(texts) if re.search(r"\bstone river\b", t)]
    everything = decontamination.contaminated(docs, items, least_words=1, common=True)
    assert rivers and pairs(everything) == sorted([(77, 0), (77, 1), (1500, 1), *rivers])


# 3


def by_hand_removed(texts):
    seen, results = set(), []
    for text in texts:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            window = raw[s : s + 100]
            if window in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = (b"\0" + bytes(gone)).count(b"\0\1")
        results.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return results


def repetitive(seed):
    pick = random.Random(seed)
    passages = [prose(seed + i, 40) for i in range(4)]
    texts = []
    for i in range(60):
        parts = [prose(seed * 100 + i, pick.randrange(30)), pick.choice(passages)[pick.randrange(50) :]]
        parts.append(pick.choice(["", "ab" * pick.randrange(200), pick.choice(texts) if texts else ""]))
        texts.append(pick.choice(["", " "]).join(parts))
    return texts


@pytest.mark.parametrize("heavy", [False, True])
def test_suffixes(spark, monkeypatch, heavy):
    texts = repetitive(3)
    if heavy:  # all anchors are spread by window
        every = np.unique(
            np.concatenate([
                suffixes.chunk_runs(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts
            ])
        )
        monkeypatch.setattr(suffixes, "heavy_anchors", lambda *_: every)
    found = suffixes.deduplicated(documents(spark, texts)).collect()
    found = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert found == [(i, *r) for i, r in enumerate(by_hand_removed(texts))]


def test_long_texts_are_cut_with_overhang(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 1000)
    texts = [prose(1, 900), prose(1, 900)[300:], prose(2, 600) * 2]
    found = suffixes.deduplicated(documents(spark, texts)).collect()
    found = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert found == [(i, *r) for i, r in enumerate(by_hand_removed(texts))]


def test_deep_shallow_sort():
    pick = np.random.default_rng(5)
    data = pick.integers(97, 99, 1500).astype(np.uint8)
    data = np.concatenate([data, data[200:800], np.full(200, 255, np.uint8), data[:50], np.zeros(200, np.uint8)])
    starts = np.arange(len(data) - 99)
    result = suffixes.deep_shallow_sort(data, starts)
    strings = [data[s : s + 100].tobytes() for s in starts[result.order]]
    assert strings == sorted(strings)
    same = [a == b for a, b in zip(strings, strings[1:])]
    assert same == [a == b for a, b in zip(result.group, result.group[1:])]


# 4


def test_rendezvous(spark):
    texts = [prose(i, i % 7) for i in range(400)]
    rows = sharding.shard_documents(documents(spark, texts), [1.0] * 8, [1.0] * 9).collect()
    by_shard = defaultdict(list)
    for r in rows:
        scores = [
            -1 / math.log((int(hashlib.md5(f"{r.doc_id}|{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)
            for s in range(9)
        ]
        assert r.shard == max(range(8), key=scores.__getitem__)
        assert r.grown_shard == max(range(9), key=scores.__getitem__)
        assert r.grown_shard in (r.shard, 8)
        assert r.size == len(texts[r.doc_id].encode()) + 1
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        by_shard[r.shard].append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())


def test_weights(spark):
    docs = documents(spark, [""] * 3000)
    rows = sharding.shard_documents(docs, [1.0, 3.0], [1.0, 3.0, 2.0]).collect()
    shares = Counter(r.shard for r in rows)
    assert 0.21 < shares[0] / len(rows) < 0.29


# 5


def plain_kneser_ney(texts, order):
    """log p(symbol | context) by the textbook, over characters."""
    counts = {order: Counter()}
    for text in texts:
        padded = "\0" * (order - 1) + text
        counts[order].update(padded[i : i + order] for i in range(len(text)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, contexts = {}, {}
    for k, table in counts.items():
        of = Counter(table.values())
        n1, n2, n3, n4 = (max(of[i], 1) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        discounts[k] = [0.0] + [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]
        contexts[k] = defaultdict(lambda: [0, 0.0])
        for gram, c in table.items():
            entry = contexts[k][gram[:-1]]
            entry[0] += c
            entry[1] += discounts[k][min(c, 3)]

    def p(gram):
        if not gram:
            return 1 / 4096
        total, freed = contexts[len(gram)].get(gram[:-1], (0, 0))
        lower = p(gram[1:])
        if not total:
            return lower
        c = counts[len(gram)][gram]
        return (max(c - discounts[len(gram)][min(c, 3)], 0) + freed * lower) / total

    return p


@pytest.mark.parametrize("shard_grams", [1 << 20, 300])
def test_perplexity(spark, shard_grams):
    from pyspark.sql import functions as F

    texts = [prose(i, 40) for i in range(30)] + ["zzz qqq", "naïve ÿ text"]
    docs = documents(spark, texts).withColumn("train", F.col("doc_id") < 20)
    table = perplexity.log_probabilities(perplexity.gram_table(docs)).cache()
    p = plain_kneser_ney(texts[:20], perplexity.ORDER)
    found = {r.doc_id: r.nll for r in perplexity.score(docs, table, shard_grams).collect()}
    for i, text in enumerate(texts):
        padded = "\0" * (perplexity.ORDER - 1) + text
        logs = [math.log(p(padded[j : j + perplexity.ORDER])) for j in range(len(text))]
        assert found[i] == pytest.approx(-sum(logs) / len(logs), rel=1e-4)


def test_classifier_on_held_out_texts(spark):
    pick = random.Random(2)
    clean = [prose(i, 120) for i in range(400)]
    junk = ["".join(pick.choice("#%&$xq ") for _ in range(400)) for _ in range(60)]
    rows = [(i, t, "en") for i, t in enumerate(clean + junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = labels(spark, [(i, 1, 0, "") for i in range(300)] + [(400 + i, 0, 0, "") for i in range(20)])
    keep = {r.doc_id: r.keep for r in perplexity.classify(docs, known).collect()}
    assert np.mean([keep[i] for i in range(300, 400)]) > 0.9
    assert not any(keep[i] for i in range(400, 460))


def test_languages_without_held_out_texts(spark):
    pick = random.Random(3)
    junk = ["".join(pick.choice("#%&$xq ") for _ in range(400)) for _ in range(20)]
    rows = [(i, prose(i, 120), "en") for i in range(300)]
    rows += [(300 + i, t, [None, "is"][i % 2]) for i, t in enumerate(junk)]
    rows += [(400 + i, prose(400 + i, 120), [None, "is"][i % 2]) for i in range(40)] + [(500, "", "is"), (501, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = labels(spark, [(i, 1, 0, "") for i in range(300)])
    found = {r.doc_id: r for r in perplexity.classify(docs, known).collect()}
    assert not any(found[300 + i].keep for i in range(20))
    assert np.mean([found[400 + i].keep for i in range(40)]) > 0.8
    assert found[500].keep and found[501].keep
    assert len({r.threshold for i, r in found.items() if i >= 300}) == 1


# 6


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_by_hand(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "ip" and any(int(x) > 255 for x in m[0].split("."))
                or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits))
                or kind == "phone" and not 10 <= len(digits) <= 15
            ):
                continue
            found.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found))


def test_base_spans(spark):
    pick = random.Random(7)
    pieces = ["a", "b.c", "@", "x-y", ".", " ", "-", "+", "1", "255", "300", "4111 1111 1111 1111", "(", ")", "é", "😀", "0012"]
    texts = ["".join(pick.choice(pieces) for _ in range(pick.randrange(40))) for _ in range(300)]
    texts += ["4111-1111-1111-1111 4012888888881881", "+1 (415) 555-2671", "a@b.c_d@e.f@g.h", "1.2.3.4.5.6.7.8", "12345" * 300]
    rows = private.digest(private.private_spans(documents(spark, texts))).collect()
    for r in rows:
        expected = base_by_hand(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(expected.encode()).hexdigest(), texts[r.doc_id]
        assert ",".join(s for s in r.spans.split(",") if s[:4] != "term") == expected


def test_revealing_terms(spark):
    texts = [f"note {i} boss Zorblatt wrote zorblatt@corp.com the thing {i}" for i in range(4)]
    texts += [f"the thing number {i} is common" for i in range(60)] + ["Only ZORBLATT here", "a zorblatts note"]
    spans = {r.doc_id: r.spans for r in private.digest(private.private_spans(documents(spark, texts))).collect()}
    assert "term:12:20" in spans[0] and "email:27:44" in spans[0]
    assert "the" not in [texts[0][int(a) : int(b)] for _, a, b in (s.split(":") for s in spans[0].split(","))]
    assert spans[5] == "" and spans[64] == "term:5:13"
    clean = {r.doc_id: r.text for r in private.sanitised(documents(spark, texts)).collect()}
    assert "orblatt" not in clean[0] and "[EMAIL]" in clean[0] and clean[5] == texts[5]


def test_terms_are_counted_before_the_candidates_are_looked_for(spark):
    texts = [f"note {i} boss Zorblatt wrote zorblatt@corp.com the thing {i}" for i in range(4)]
    docs = documents(spark, texts + [f"the thing number {i}" for i in range(9)])
    rated = private.revealing_terms(private.stage(private._found(docs), "found"), docs)
    # Spark moves a semi join below the counting, where it meets each document's words.
    assert "LeftSemi" not in rated._jdf.queryExecution().optimizedPlan().toString()
    assert "zorblatt" in [r.term for r in rated.collect()]


# 7


def anchors_by_hand(text):
    raw = text.encode()
    found = []
    for i in range(len(raw) - syncmers.K + 1):
        run = raw[i : i + syncmers.K]
        inner = [
            int(syncmers._mixed(np.array([int.from_bytes(run[j : j + syncmers.S], "little")], np.uint64))[0])
            for j in range(syncmers.K - syncmers.S + 1)
        ]
        if min(inner) in (inner[0], inner[-1]):
            found.append(run)
    return list(dict.fromkeys(found))


def test_syncmers(spark):
    texts = [prose(1, 60), prose(2, 3), "", prose(1, 60), prose(3, 40), "x" * 100, prose(4, 30)]
    for text in texts:
        if len(text.encode()) >= syncmers.K:
            assert len(syncmers.anchors([text])[0]) == max(len(anchors_by_hand(text)), 1)
    together = syncmers.anchors(texts)
    assert all((a == syncmers.anchors([t])[0]).all() for a, t in zip(together, texts))
    shared = set(syncmers.anchors([texts[0]])[0]) & set(syncmers.anchors(["other start " + texts[0]])[0])
    assert shared == set(syncmers.anchors([texts[0]])[0])


def test_edited(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "BUCKET_BYTES", 2000)  # several buckets
    texts = [prose(i, 20 + i) for i in range(40)] + ["é" * 7, "", prose(0, 20)]
    rows = {r.doc_id: r for r in syncmers.fingerprints(documents(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        following = texts[i - 1]  # descending ids, the last followed by the first
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i].fingerprint == syncmers.printed(syncmers.anchors([text])[0])
        assert rows[i].edited_fingerprint == syncmers.printed(syncmers.anchors([edited])[0])
    assert rows[0].fingerprint == rows[42].fingerprint
    assert np.mean([r.near_edited for r in rows.values()]) > 0.5  # about two thirds stay
    assert np.mean([r.near_next for r in rows.values()]) < 0.1


# 8


def test_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 700, None: 90}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(df).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1]))
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while open_:  # share out, cap, share out the rest again
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weights[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    assert found == pytest.approx(target)


def test_mix_is_near_its_targets(spark):
    from pyspark.sql import functions as F

    pick = random.Random(3)
    rows = [(i, prose(i, pick.randrange(30)), pick.choice(["a", "a", "a", "b", "c", None])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = mixing.measured(docs)
    plan = mixing.source_plan(sized)
    taken = mixing.with_rounds(sized, plan).withColumn("taken", F.col("rounds") * F.col("size"))
    sums = taken.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("rounds").alias("rounds"))
    for r in sums.collect():
        assert abs(r.taken - r.target) <= 30 and r.rounds <= 2
    total = mixing.mixed(docs).agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0))))).first()[0]
    assert total == taken.agg(F.sum("taken")).first()[0]


@pytest.mark.parametrize("ids", [lambda i: 7, lambda i: None])
@pytest.mark.parametrize("texts", [lambda i: prose(i, 20), lambda i: prose(1, 20)])
def test_mix_splits_rows_of_one_id(spark, ids, texts):
    rows = [(ids(i), texts(i), "a" if i < 200 else "b") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    sized = mixing.measured(docs)
    longest = max(r.size for r in sized.collect())
    taken = mixing.with_rounds(sized, mixing.source_plan(sized)).collect()
    assert len(taken) == 1000
    for source in "ab":
        mine = [r for r in taken if r.source == source]
        words = sum(r.rounds * r.size for r in mine)
        assert abs(words - mine[0].target) <= longest and max(r.rounds for r in mine) <= 2
    assert len({r.rounds for r in taken if r.source == "b"}) == 2
    total = mixing.mixed(docs).count()
    assert total == sum(r.rounds for r in taken)


# 9


def test_simhash_bits():
    from xxhash import xxh64_intdigest

    for text in ("", "one", "One  two", "A b c", "the the the the the", prose(5, 50)):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
        hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.simhash(text) == bits


def test_links_between_all_close_fingerprints(spark):
    pick = random.Random(9)
    values = set()
    for _ in range(150):
        value = pick.getrandbits(64)
        for _ in range(pick.randrange(1, 6)):
            values.add(value)
            for _ in range(pick.randrange(1, 5)):
                value ^= 1 << pick.randrange(64)
    values = sorted(values)
    parent = {v: v for v in values}
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                ra, rb = simhash._root(parent, a), simhash._root(parent, b)
                parent[max(ra, rb)] = min(ra, rb)
    groups = defaultdict(set)
    for v in values:
        groups[simhash._root(parent, v)].add(v)
    fps = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    stars = simhash.contract(simhash.links(fps)).collect()
    found = defaultdict(set)
    for r in stars:
        found[r.root] |= {r.a & (2**64 - 1), r.root & (2**64 - 1)}
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_bk_tree():
    pick = random.Random(4)
    members = list({pick.getrandbits(12) for _ in range(300)})
    tree = simhash.BKTree(members[0])
    for m in members[1:]:
        tree.add(m)
    for value in (0, members[5], 4095):
        expected = sorted(m for m in members if (m ^ value).bit_count() <= 2)
        assert sorted(tree.near(value, 2)) == expected


def test_components_take_the_smallest_id(spark):
    texts = [prose(1, 60), prose(2, 60), prose(1, 60), prose(1, 60).upper(), "", None]
    rows = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    assert rows == {0: 0, 1: 1, 2: 0, 3: 0, 4: 4, 5: 4}
    kept = {r.doc_id for r in simhash.one_of_each(documents(spark, texts)).collect()}
    assert kept == {0, 1, 4}


# 10


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_permutation(size):
    slots = training_order.feistel(np.arange(size), size)
    assert sorted(slots.tolist()) == list(range(size))
    if size > 500:
        assert np.corrcoef(np.arange(size), slots)[0, 1] < 0.2
        assert (slots != training_order.feistel(np.arange(size), size, key=1)).any()


@pytest.mark.skipif(not Path(training_order.VOCABULARY).exists(), reason="no vocabulary")
def test_round_trip(spark, tmp_path):
    texts = [prose(i, 10 * i) + " naïve 😀\n\n it's  1234" for i in range(40)]
    docs = documents(spark, texts)
    order = training_order.training_order(docs, sequence=32, shard_slots=50)
    rows = sorted(order.collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows)))
    tokenizer = training_order.encoding(training_order.VOCABULARY)
    for i, text in enumerate(texts):
        parts = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.part)
        ids = np.concatenate([np.frombuffer(r.ids, "<u2")[: r.n_tokens] for r in parts])
        assert ids[-1] == 50256 and tokenizer.decode(ids[:-1].tolist()) == text
    path = str(tmp_path / "shards")
    training_order.write_shards(order, path)
    files = sorted(Path(path).glob("shard=*/*.txt"))
    assert len(files) == -(-len(rows) // 50)
    first = next(f for f in files if "shard=0" in str(f)).read_bytes()
    assert all(first[r.byte_offset : r.byte_offset + 64] == r.ids for r in rows[:50])
    resumed = training_order.read_from(spark, path, 77, sequence=32, shard_slots=50).collect()
    assert sorted((r.slot, bytes(r.ids)) for r in resumed) == [(r.slot, bytes(r.ids)) for r in rows[77:]]


def test_vocabulary_of_words():
    assert len(WORDS) == len(set(WORDS))


def test_calls_after_staging(spark):
    """A long job can tidy the driver after each of its tables, and only while it runs."""
    from tillroll.session import after_staging, stage

    called = []
    with after_staging(called.append):
        stage(spark.range(3), "one")
        assert stage(spark.range(4), "two").count() == 4
    stage(spark.range(5), "three")
    assert called == [spark, spark]


def test_counting_characters_takes_little_memory():
    """Two MB of text at once took over 150 MB of arrays."""
    import pyarrow as pa
    import pyarrow.compute as pc

    pick = random.Random(6)
    texts = ["".join(pick.choices("abcdefghij klmnop", k=2000)) for _ in range(3000)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "train": [i % 2 == 0 for i in range(3000)]})
    tracemalloc.start()
    try:
        counted = sum(pc.sum(found.column("n")).as_py() for found in perplexity._count_grams([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert counted == 1500 * 2000
    assert peak < 130 << 20


def test_executors_are_tidied(spark):
    from tillroll.llm.batches import tidy_executors

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()

    def collections():
        return sum(bean.getCollectionCount() for bean in beans)

    before = collections()
    tidy_executors(spark)  # in local mode the executor's heap is the driver's
    assert collections() > before
