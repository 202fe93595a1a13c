"""The registered queries of this subpackage, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import (
    conversations,
    decontamination,
    html_text,
    inner_products,
    mixing,
    perplexity,
    phrases,
    private,
    sharding,
    simhash,
    suffixes,
    syncmers,
    training_order,
)
from tillroll.session import stage

SHARDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op4_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.shard_documents(docs, [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op5_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return perplexity.classify(docs.select("doc_id", "lang", "text"), labels).drop("text")


def op6_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.digest(private.private_spans(table(spark, sf_dir, "documents")))


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = stage(mixing.measured(table(spark, sf_dir, "documents")), "sizes")
    plan = stage(mixing.source_plan(sized), "mix")
    return mixing.with_rounds(sized, plan).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("rounds") * F.col("size")).cast("long").alias("taken"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    printed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", printed.alias("fingerprint"), "component_id")


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_order(table(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return conversations.summary(conversations.repaired(conversations.damaged(given), given.select("conv_id")))


def op12_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_products.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
with sized as (
  select doc_id, source,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || ' ' || coalesce(text, '')), 1, 15)
              as bigint) as hash
  from documents
), sources as (
  select source, cast(sum(size) as bigint) as source_size,
         [3, 1, 2][1 + (row_number() over (order by source nulls last) - 1) % 3] as w
  from sized group by source
), filling as (
  select source, source_size, w, 2 * source_size as cap,
         (sum(source_size) over () * 1.5::double
          - coalesce(sum(2 * source_size) over (order by 2 * source_size / w, source nulls last
              rows between unbounded preceding and 1 preceding), 0))
         / sum(w) over (order by 2 * source_size / w, source nulls last
              rows between current row and unbounded following) as level
  from sources
), targets as (
  select source, source_size,
         least(cast(cap as double), coalesce(w * (
           select min_by(level, cap / w) from filling where level * w <= cap), cap)) as target
  from filling
), budgets as (
  select source, source_size, target,
         coalesce(cast(floor(target / nullif(source_size, 0)) as bigint), 0) as whole
  from targets
), runs as (
  select s.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size as words_left,
         sum(size) over same as hash_words, count(*) over same as copies,
         row_number() over (partition by s.source, hash) as copy,
         sum(size) over (partition by s.source order by hash) - sum(size) over same as before
  from sized s join budgets b on s.source is not distinct from b.source
  window same as (partition by s.source, hash)
), boundary as (
  select *, max(case when before <= words_left then hash end) over (partition by source) as last_hash
  from runs
)
select doc_id, size, source_size, target,
       cast(size * (whole + case when hash < last_hash
            or hash = last_hash
               and copy <= floor((words_left - before) * copies / nullif(hash_words, 0) + 0.5)
            then 1 else 0 end) as bigint) as taken
from boundary
"""

OP12_SQL = r"""
with vectors as (
  select vec_id, row_number() over () as row,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select q.row, q.vec_id as query_id, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) as score
  from vectors q join vectors c on q.row <> c.row where q.vec_id % 50 = 0
)
select query_id, vec_id, cast(score as bigint) as score,
       cast(row_number() over (partition by row order by score desc, vec_id nulls last) as integer) as rank
from pairs qualify rank <= 5
"""

OP13_SQL = r"""
with pieces as (
  select row_number() over () as piece, * from (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) as part
    from documents)
), words as (
  select lang, piece, unnest(ws) as w1, generate_subscripts(ws, 1) as place
  from (select lang, piece, regexp_extract_all(part, '[^\x20\x09]+') as ws from pieces)
), triples as (
  select lang, w1, lead(w1) over same as w2, lead(w1, 2) over same as w3
  from words window same as (partition by piece order by place)
), one as (select lang, w1, count(*) as f from triples group by all),
two as (select lang, w1, w2, count(*) as f from triples where w2 is not null group by all having f >= 10),
three as (select lang, w1, w2, w3, count(*) as f from triples where w3 is not null group by all having f >= 10),
totals as (select lang, count(*) as n from words group by lang),
cuts as (
  select lang, w1 || ' ' || w2 as phrase, t.f as a, p.f as l, q.f as r, 1 as k
  from two t join one p using (lang, w1) join one q on q.lang = t.lang and q.w1 = t.w2
  where not exists (from three h where h.lang = t.lang and 100 * h.f >= 50 * t.f
                    and (h.w1 = t.w1 and h.w2 = t.w2 or h.w2 = t.w1 and h.w3 = t.w2))
  union all
  select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, p.f, q.f, 1
  from three t join one p using (lang, w1) join two q on q.lang = t.lang and q.w1 = t.w2 and q.w2 = t.w3
  union all
  select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, p.f, q.f, 2
  from three t join two p using (lang, w1, w2) join one q on q.lang = t.lang and q.w1 = t.w3
), scored as (
  select *, cast((1000000::hugeint * a * a) // (l::hugeint * r) as bigint) as score from cuts
), lowest as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank
  from lowest qualify rank <= 2000
)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_main_text": op1_main_text,
        "op2_decontaminate": op2_decontaminate,
        "op3_suffixes": op3_suffixes,
        "op4_rendezvous": op4_rendezvous,
        "op5_perplexity": op5_perplexity,
        "op6_private": op6_private,
        "op7_syncmers": op7_syncmers,
        "op8_mix": op8_mix,
        "op9_simhash": op9_simhash,
        "op10_training_order": op10_training_order,
        "op11_conversations": op11_conversations,
        "op12_inner_products": op12_inner_products,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_mix": OP8_SQL, "op12_inner_products": OP12_SQL, "op13_collocations": OP13_SQL}
