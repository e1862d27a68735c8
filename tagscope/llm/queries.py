"""One registered query per operator, over its whole table, and DuckDB SQL
where SQL can express it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagscope.llm import (ann, bpe_automaton, html_templates, mixing, ngram_join, quality_gbdt, quality_rules,
                          ranked_search, secrets, spelling, token_frames, tool_chat, toxicity)
from tagscope.llm.common import shared_dir, table

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---- 1: HTML extraction ------------------------------------------------------------
@register("op1_main_text")
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_templates.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


# ---- 2: approximate nearest neighbours ------------------------------------------
@register("op2_nearest_vectors")
def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


# ---- 3: mixing sources to target weights ----------------------------------------
MIX_SQL = f"""
with sized as (
  select doc_id, source, case when text is null then 0 else len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) end::bigint as size,
         md5('{mixing.SEED}:' || coalesce(cast(doc_id as varchar), 'null')) as h
  from documents),
tot as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (select *, [{', '.join(map(str, mixing.WEIGHTS))}][((row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)}) + 1] as w,
                  {mixing.MAX_EPOCHS} * source_size as cap from tot),
lev as (select *, row_number() over o as pos,
               (sum(source_size) over () - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))::double
               / sum(w) over (o rows between current row and unbounded following) as lvl
        from ranked window o as (order by cap / w, source nulls last)),
stop as (select min(pos) as pos0, arg_min(lvl, pos) as lvl0 from lev where cap > lvl * w),
tgt as (select source as s, source_size, case when pos0 is null or pos < pos0 then cap::double else lvl0 * w end as target from lev, stop),
ex as (select *, case when source_size > 0 then least(floor(target / source_size), {mixing.MAX_EPOCHS}) else 0 end::bigint as whole from tgt),
run as (select d.*, source_size, target, whole, round(target)::bigint - whole * source_size as extra,
               sum(size) over (partition by source order by h, doc_id, size rows unbounded preceding) - size as start
        from sized d join ex on d.source is not distinct from ex.s)
select doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, extra - start)))::bigint as taken from run"""


@register("op3_mix_sources", MIX_SQL)
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")) \
        .select("doc_id", "size", "source_size", "target", "taken")


# ---- 5: secret scans ----------------------------------------------------------------
@register("op5_secret_links")
def op5_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs).select("doc_id", "secret_spans")

    def count(kind):
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in secrets.STRONG],
        F.sha2(secrets.joined_spans(secrets.strong_spans(F.col("secret_spans"))).cast("binary"), 256).alias("base_sha256"),
        secrets.joined_spans(F.col("secret_spans")).alias("spans"))


# ---- 7: chat formatting --------------------------------------------------------------
@register("op7_tool_chats")
def op7_tool_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of ``conversations``, in the tool wire format, formatted."""
    return tool_chat.format_chats(tool_chat.as_tool_transcript(table(spark, sf_dir, "conversations")), tool_chat.ANSWER_SCHEMA)


# ---- 9: n-gram Jaccard join ----------------------------------------------------------
@register("op9_ngram_join")
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents"))


# ---- 10: BPE encoding and decoding ------------------------------------------------
def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@register("op10_bpe_automaton")
def op10_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_documents(table(spark, sf_dir, "documents"), vocabulary(), ids=False)


# ---- 4, 6, 8: models over texts ------------------------------------------------------
@register("op4_quality_trees")
def op4_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbdt.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op6_toxicity_chain")
def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@register("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


# ---- 11: spelling variants ------------------------------------------------------------
# crc32 byte by byte with a table made from the polynomial; near words by equal rests
# after deleting one place; roots by recursion.
SPELLING_SQL = """
with recursive bits as (
  select i, 0 as k, i as c from range(256) t(i)
  union all
  select i, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from bits where k < 8),
crc as (select list(c order by i) as tbl from bits where k = 8),
runs as (
  select run, coalesce(doc_id::varchar, 'null') as id, count(*) as k
  from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[A-Za-z\u00C0-\u00FF]+')) as run from documents)
  where length(run) >= 6 group by all),
bytes as (
  select id, run, k, hex(encode(id || ':' || run)) as h from runs),
hashed as (
  select run, k, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length(h) // 2),
           lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
           lambda c, b: xor(c // 256, tbl[(xor(c, b) & 255) + 1]::bigint)), 4294967295::bigint) as c
  from bytes, crc),
vocab as (
  select word, sum(k)::bigint as n
  from (select k, case when c % 199 = 0 then substr(run, 1, (c % length(run))::int) || substr(run, (c % length(run))::int + 2) else run end as word
        from hashed)
  where length(word) >= 6 group by word having sum(k) >= 5),
holes as (
  select word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) as rest
  from (select word, n, unnest(range(1, length(word) + 1)) as p from vocab)),
near as (
  select a.word, b.word as other, b.n as other_n from holes a join holes b on a.p = b.p and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from holes a join vocab b on a.rest = b.word
  union select b.word, a.word, a.n from holes a join vocab b on a.rest = b.word),
best as (
  select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from near group by word),
forms as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when other_n >= 5 * v.n then other end as form,
         case when other_n >= 5 * v.n then other_n end as form_n
  from vocab v left join best using (word)),
chain as (
  select word, word as at from forms
  union all
  select c.word, f.form from chain c join forms f on f.word = c.at where f.form is not null)
select f.word, f.form, c.at as root, f.n, f.n_near::bigint as n_near, f.form_n
from forms f join chain c using (word) join forms e on e.word = c.at where e.form is null"""


@register("op11_spelling_groups", SPELLING_SQL)
def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


# ---- 12: ranked lexical search ------------------------------------------------------
SEARCH_SQL = r"""
with lowered as (
  select row_number() over () as r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
tok as (
  select r, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from lowered),
lens as (select r, any_value(doc_id) as doc_id, count(*) as n from tok group by r),
tot as (select count(*)::bigint as nn, sum(n)::bigint as ll from lens),
asked as (
  select i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as i, item_id, text from benchmark)),
qt as (select i, item_id, term, count(*) as k from asked group by all),
tfs as (select r, term, count(*)::bigint as tf from tok where term in (select term from qt) group by all),
w as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)))::bigint as w from tfs, tot group by term, nn),
gains as (
  select r, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // ll))) as g
  from tfs join w using (term) join lens using (r), tot),
scored as (
  select i, item_id, doc_id, r, sum(k * g)::bigint as score from qt join gains using (term) join lens using (r)
  group by i, item_id, doc_id, r having sum(k * g) > 0),
ranked as (select *, row_number() over (partition by i order by score desc, doc_id nulls last, r) as rk from scored)
select item_id, rk::int as rank, doc_id, score from ranked where rk <= 20"""


@register("op12_ranked_search", SEARCH_SQL)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# ---- 13: token-id output -----------------------------------------------------------
@register("op13_token_frames")
def op13_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = token_frames.documents_to_frames(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/token-frames-{uuid.uuid4().hex}",
                                            public_tokenizers.path("byte_bpe_50k.json"))
    return held.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
