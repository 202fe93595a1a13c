"""Personal data: exact kinds, and terms that give a protected entity away.

Emails, addresses, cards and phone numbers are found by pattern and checked.
Each distinct value is a protected entity.  A term that stands near an entity
reveals it to the degree to which its presence lessens the entity's
information: ``PMI(entity; term) / IC(entity)``, from the documents of the whole
corpus that hold the entity, the term, and both.  The ratio is 1 where the term
never occurs without the entity near it, and 0 where the two are independent.
Terms at or above ``DISCLOSURE`` for some entity, with ``SUPPORT`` different texts
behind it, become spans of kind ``term`` wherever they occur: removed at or
above ``REMOVAL``, otherwise generalised to a placeholder.

DataFrame functions only.  Patterns are written so that Java neither recurses
nor rescans: quantifiers are possessive where nothing can be given back, and
a match starts where its run of characters starts, or after the last match.

Edge cases: null and empty texts have no spans (the hash is that of the empty
string); repeated rows give repeated results and count as one text for
``SUPPORT``; a null id is kept; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.operators.joins import join_lookup
from tillroll.session import stage

KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Runs of fewer digits could only be matches that fail.
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

NEAR = 100  # code points on either side of an entity
WORD = r"[\p{L}\p{N}_]"
TERM = rf"{WORD}{{3,64}}+"
SUPPORT = 3
DISCLOSURE = 0.9
REMOVAL = 0.98


def _spans(text: Column, pattern: Column, kind: str, valid) -> Column:
    """Array of (start, rank, end, kind, hit) of the valid matches, in order.

    The texts between matches and the matches, added up, give the places in
    code points.
    """
    pairs = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")),
    )
    nothing = F.array().cast("array<struct<start:int,hit:string>>")
    placed = F.aggregate(
        F.filter(pairs, lambda p: p["hit"].isNotNull()),
        F.struct(nothing.alias("out"), F.lit(0).alias("at")),
        lambda done, p: F.struct(
            F.concat(
                done["out"],
                F.array(F.struct((done["at"] + F.length(p["gap"])).alias("start"), p["hit"].alias("hit"))),
            ).alias("out"),
            (done["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("at"),
        ),
        lambda done: done["out"],
    )
    return F.transform(
        F.filter(placed, lambda s: valid(s["hit"])),
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            (s["start"] + F.length(s["hit"])).alias("end"),
            F.lit(kind).alias("kind"),
            s["hit"].alias("hit"),
        ),
    )


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, r"[^0-9]", "")


def _luhn(hit: Column) -> Column:
    digits = F.reverse(_digits(hit))
    values = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
    )
    total = F.aggregate(values, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0))
    return total % 10 == 0


def base_spans(text: Column) -> Column:
    """All valid matches of the four patterns, by start, then kind."""
    checks = {
        "email": (EMAIL, F.contains(text, F.lit("@")), lambda hit: F.lit(True)),
        "ip": (IP, text.rlike(r"[0-9]\.[0-9]"), lambda hit: hit.rlike(rf"^(?:{PART}\.){{3}}{PART}$")),
        "card": (
            CARD,
            text.rlike(CARD),
            lambda hit: F.when(F.length(_digits(hit)).between(14, 19), _luhn(hit)).otherwise(False),
        ),
        "phone": (PHONE, F.contains(text, F.lit("+")), lambda hit: F.length(_digits(hit)).between(10, 15)),
    }
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,hit:string>>")
    found = [
        F.when(maybe, _spans(text, F.lit(pattern), kind, valid)).otherwise(none)
        for kind, (pattern, maybe, valid) in checks.items()
    ]
    return F.array_sort(F.concat(*found))


def _entity(span: Column) -> Column:
    plain = F.when(span["kind"].isin("card", "phone"), _digits(span["hit"])).otherwise(F.lower(span["hit"]))
    return F.concat(span["kind"], F.lit(":"), plain)


def _terms(text: Column) -> Column:
    """Words of three letters and more, lowered."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _without_base(text: Column) -> Column:
    for pattern in (EMAIL, IP, CARD, PHONE):
        text = F.regexp_replace(text, pattern, "\n")
    return text


def _nearby(text: Column, span: Column) -> Column:
    """Distinct terms within ``NEAR`` code points of the span."""
    low = F.greatest(span["start"] - NEAR, F.lit(0))
    before = F.substring(text, low + 1, span["start"] - low)
    after = F.substring(text, span["end"] + 1, F.lit(NEAR))
    return F.array_distinct(_terms(_without_base(F.concat(before, F.lit("\n"), after))))


def _found(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, near): the spans of each document, and what stands near them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("text_hash"), base_spans(F.col("text")).alias("base")
    )
    near = F.transform(
        "base", lambda s: F.struct(_entity(s).alias("entity"), _nearby(F.col("text"), s).alias("terms"))
    )
    return rows.select("doc_id", "text_hash", "base", near.alias("near"))


def revealing_terms(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, disclosure) of the terms that reveal some entity at or above ``DISCLOSURE``.

    Counts are of documents: with the entity, with the term near it, and with
    the term anywhere, over the whole corpus.
    """
    documents = found.count()
    near = found.select("doc_id", "text_hash", F.explode("near").alias("n")).select(
        "doc_id", "text_hash", "n.entity", "n.terms"
    )
    entities = (
        near.select("doc_id", "text_hash", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    )
    # A repeated entity is rare and a unique one reveals nothing by support.
    texts = near.select("text_hash", "entity").distinct().groupBy("entity").count()
    known = stage(texts.where(F.col("count") >= SUPPORT).select("entity"), "entities")
    pairs = join_lookup(near, known, "entity").select(
        "doc_id", "text_hash", "entity", F.explode("terms").alias("term")
    )
    by_text = pairs.groupBy("entity", "term", "text_hash").agg(F.count_distinct("doc_id").alias("docs"))
    both = by_text.groupBy("entity", "term").agg(
        F.sum("docs").alias("n_et"), F.count("*").alias("texts")
    )
    both = stage(both.where(F.col("texts") >= SUPPORT).join(entities, "entity"), "pairs")
    candidates = stage(both.select("term").distinct(), "candidates")
    # Not a semi join, which would be moved below the counting and meet every occurrence.
    n_t = join_lookup(term_counts(docs), candidates, "term")
    joint = F.log2(F.col("n_et") * F.lit(float(documents)) / (F.col("n_e") * F.col("n_t")))
    own = F.log2(F.lit(float(documents)) / F.col("n_e"))
    degree = F.when(own > 0, F.least(joint / own, F.lit(1.0)))
    rated = both.join(n_t, "term").withColumn("disclosure", degree)
    return rated.where(F.col("disclosure") >= DISCLOSURE).groupBy("term").agg(
        F.max("disclosure").alias("disclosure")
    )


def _document_words(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, term): all terms of each document, each once."""
    return docs.select(
        "doc_id",
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.explode(F.array_distinct(_terms(F.coalesce("text", F.lit(""))))).alias("term"),
    )


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n_t): documents with each term, added up before any join."""
    return _document_words(docs).groupBy("term").agg(F.count("*").alias("n_t"))


def document_terms(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text_hash, term): the wanted terms of each document, each once."""
    words = _document_words(docs)
    return join_lookup(words, wanted.select("term"), "term", "left_semi", count_on=wanted)


def _term_spans(docs: DataFrame, revealing: DataFrame) -> DataFrame:
    """(key, terms, removed): spans of revealing terms, for documents that have some.

    ``removed`` are the terms that reveal so much that no placeholder may stand.
    """
    held = document_terms(docs, revealing).distinct().join(revealing, "term").groupBy(
        "doc_id", "text_hash"
    ).agg(
        F.array_sort(F.collect_set("term")).alias("words"),
        F.collect_set(F.when(F.col("disclosure") >= REMOVAL, F.col("term"))).alias("removed"),
    )
    held = stage(held.withColumn("key", _row_key()).select("key", "words", "removed"), "held-terms")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "text_hash", F.xxhash64("text")
    )
    marked = join_lookup(texts.dropDuplicates(["doc_id", "text_hash"]).withColumn("key", _row_key()), held, "key")
    pattern = F.concat(
        F.lit(rf"(?iu)(?<!{WORD})(?:"), F.array_join("words", "|"), F.lit(rf")(?!{WORD})")
    )
    return marked.select(
        "key",
        _spans(F.col("text"), pattern, "term", lambda hit: F.lit(True)).alias("terms"),
        "removed",
    )


def _row_key() -> Column:
    """A document's key; documents with one id and one text share it."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_hash")


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def private_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, spans, removed): base spans, and these with the revealing terms."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    found = stage(_found(docs), "base-spans")
    revealing = stage(revealing_terms(found, docs), "revealing")
    more = _term_spans(docs, revealing)
    keyed = found.withColumn("key", _row_key()).select("key", "doc_id", "text_hash", "base")
    free = F.filter(
        "terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    )
    every = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", free)))
    gone = F.coalesce("removed", F.array().cast("array<string>"))
    return keyed.join(more, "key", "left").select(
        "doc_id", "text_hash", "base", every.alias("spans"), gone.alias("removed")
    )


def sanitised(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts with entities and generalised terms as ``[KIND]``, removed terms gone.

    Where spans overlap the first decides and the others' rest goes with it.
    """
    spans = private_spans(docs).withColumn("key", _row_key()).dropDuplicates(["key"])
    spans = stage(spans.where(F.size("spans") > 0).select("key", "spans", "removed"), "spans")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    keyed = texts.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    marked = join_lookup(keyed.withColumn("key", _row_key()), spans, "key", "left")
    gone = lambda s: (s["kind"] == "term") & F.array_contains("removed", F.lower(s["hit"]))
    put = lambda s: F.when(gone(s), "").otherwise(
        F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
    )
    written = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda done, s: F.struct(
            F.when(
                s["start"] >= done["at"],
                F.concat(
                    done["out"],
                    F.substring(F.col("text"), done["at"] + 1, s["start"] - done["at"]),
                    put(s),
                ),
            ).otherwise(done["out"]).alias("out"),
            F.greatest(done["at"], s["end"]).alias("at"),
        ),
        lambda done: F.concat(
            done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text"))
        ),
    )
    return marked.select(
        "doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(written).alias("text")
    )


def digest(spans: DataFrame) -> DataFrame:
    """Counts, hash of the base spans and list of all spans of each document."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )
