"""The registered queries of the operators: each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from durata.llm import (
    chat,
    decontamination,
    fill_in_middle,
    hard_negatives,
    line_frequency,
    lines,
    mixing,
    quality,
    secret_scan,
    simhash,
    token_counts,
    top_k,
    toxicity,
)
from durata.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(fn: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, folder: fn(*[table(spark, folder, n) for n in names])


QUERIES: dict[str, Query] = {
    "op1_secret_scan": _on(secret_scan.op1_secret_scan, "documents"),
    "op2_simhash_near_dedup": _on(simhash.op2_simhash, "documents"),
    "op3_chat_formatting": _on(chat.op3_chat_formatting, "conversations"),
    "op4_quality_classifier": _on(quality.op4_quality, "documents", "labels"),
    "op5_line_dedup": _on(lines.op5_line_dedup, "documents"),
    "op6_toxicity": _on(toxicity.op6_toxicity, "documents", "labels"),
    "op7_exact_top_k": _on(top_k.op7_exact_top_k, "embeddings"),
    "op8_source_mixing": _on(mixing.op8_mixing, "documents"),
    "op9_benchmark_decontamination": _on(
        decontamination.op9_decontamination, "documents", "benchmark"
    ),
    "op10_token_counts": _on(token_counts.op10_token_counts, "documents"),
    "op11_hard_negatives": _on(hard_negatives.op11_hard_negatives, "embeddings"),
    "op12_fill_in_middle": _on(fill_in_middle.op12_fill_in_middle, "documents"),
    "op13_quality_rules": _on(line_frequency.op13_quality_rules, "documents"),
}

TOP_K_SQL = """
with v as (
  select vec_id as id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.id as query_id, b.id as vec_id,
         list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score
  from v a join v b on a.id % 20 = 0 and a.id <> b.id
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
"""

CHAT_SQL = r"""
with said as (
  select conv_id, turn, role, text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t as (
  select conv_id, turn, coalesce(role, '') as role, text as given, coalesce(text, '') as text,
         '\\|<\||</?s>|\[/?INST\]|<</?SYS>>' as control
  from said
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, given nulls first)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, given nulls first) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length('<|turn|><|body|><|end|>') + length(role) + len(regexp_extract_all(role, control))
           + length(text) + len(regexp_extract_all(text, control)))::bigint as formatted_chars
from t group by conv_id
"""

MIXING_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as r
  from documents
), s as (
  select source, sum(size)::bigint as source_size,
         (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight
  from d group by source
), o as (
  select *, 3 * source_size / weight as reach from s
), c as (
  -- sources whose share stops at three times their size come first
  select reach,
         ((select sum(source_size) from s) - coalesce(sum(3 * source_size) over before, 0))::double
         / sum(weight) over (order by reach, source nulls last rows between current row and unbounded following) as level
  from o
  window before as (order by reach, source nulls last rows between unbounded preceding and 1 preceding)
), l as (
  select coalesce((select level from c where reach > level order by reach limit 1), 0) as level
), g as (
  select source, source_size, least(weight * level, (3 * source_size)::double) as target from s, l
), p as (
  select d.doc_id, d.size, g.source_size, g.target, round(g.target)::bigint as goal,
         coalesce(sum(d.size) over (partition by d.source order by d.r, d.doc_id, d.size
                                    rows between unbounded preceding and 1 preceding), 0) as before
  from d join g on d.source is not distinct from g.source
)
select doc_id, size, source_size, target,
       case when source_size = 0 then 0
            else goal // source_size * size + greatest(0, least(size, goal % source_size - before)) end::bigint as taken
from p
"""

#: SQL of the queries that it can express on the same tables.
ORACLE: dict[str, str] = {
    "op3_chat_formatting": CHAT_SQL,
    "op7_exact_top_k": TOP_K_SQL,
    "op8_source_mixing": MIXING_SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op12_fill_in_middle": fill_in_middle.SQL,
    "op13_quality_rules": line_frequency.SQL,
}
