"""Registered queries of the operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.llm.clustering import cluster_vectors
from loomgraph.llm.decontamination import find_items
from loomgraph.llm.exact_dedup import exact_dedup
from loomgraph.llm.language_id import identify, training_rows
from loomgraph.llm.lexical_search import lexical_search
from loomgraph.llm.line_dedup import line_dedup
from loomgraph.llm.lm import lm_score
from loomgraph.llm.mixing import mix_sources
from loomgraph.llm.ngram_join import near_duplicates
from loomgraph.llm.pii import find_pii
from loomgraph.llm.quality import score_quality
from loomgraph.llm.quality_rules import quality_rules
from loomgraph.llm.substring_dedup import substring_dedup
from loomgraph.llm.textops import fold, table


def op1_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, training_rows(docs, fold(F.col("doc_id"), 4) != 2))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op3_line_dedup(spark, sf_dir):
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_quality_crf(spark, sf_dir):
    held_out = fold(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").filter(~held_out)
    out = score_quality(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_lm_score(spark, sf_dir):
    held_out = fold(F.col("doc_id"), 5) == 1
    out = lm_score(table(spark, sf_dir, "documents"), train=~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_pii(spark, sf_dir):
    out = find_pii(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op7_ngram_jaccard(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"), size=3, num=9, den=10)
    return out.select("doc_id", "n_shingles", "component_id")


def op8_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))


def op9_decontamination(spark, sf_dir):
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_quality_rules(spark, sf_dir):
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_centroid_clustering(spark, sf_dir):
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark, sf_dir):
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_id": op2_language_id,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_crf": op4_quality_crf,
    "op5_lm_score": op5_lm_score,
    "op6_pii": op6_pii,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_mixing": op8_mixing,
    "op9_decontamination": op9_decontamination,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_quality_rules": op11_quality_rules,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_lexical_search": op13_lexical_search,
}

#: One round: distances to all centroids, nearest ones, floors of the means.
CLUSTER_ROUND = """
d{i} as materialized (
  select r, c, sum((comp.x - c{i}.x) * (comp.x - c{i}.x))::bigint as distance from comp join c{i} using (d) group by r, c),
a{i} as materialized (
  select r, c, distance from (select *, row_number() over (partition by r order by distance, c) as k from d{i}) where k = 1),
m{i} as materialized (select c, d, floor(sum(x)::double / count(*))::bigint as x from a{i} join comp using (r) group by c, d),
c{j} as materialized (select c{i}.c, c{i}.d, coalesce(m{i}.x, c{i}.x) as x from c{i} left join m{i} on m{i}.c = c{i}.c and m{i}.d = c{i}.d),"""


ORACLES = {
    "op3_line_dedup": r"""
with pieces as (
  select doc_id, source, string_split(coalesce(text, ''), chr(10)) as parts, coalesce(text, '') = '' as bare,
         row_number() over () as r from documents),
lines as (select r, source, unnest(parts) as line, generate_subscripts(parts, 1) as place from pieces),
spread as (
  select trim(line, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ') as line from lines
  where trim(line, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ') <> ''
  group by 1 having count(distinct coalesce('=' || source, '')) >= 10),
gone as (
  select r, list(place) as gone from lines
  where trim(line, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ') in (select line from spread) group by r)
select doc_id, case when bare then 0 else len(parts) end as n_lines, coalesce(len(gone), 0) as n_removed,
       sha256(case when gone is null then array_to_string(parts, chr(10)) else
         coalesce(array_to_string(list_filter(parts, lambda x, i: not list_contains(gone, i)), chr(10)), '') end) as kept_sha256
from pieces left join gone using (r)""",
    "op10_exact_dedup": r"""
with t as (select doc_id, length(coalesce(text, '')) as n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
       row_number() over w = 1 as kept, text_sha256
from t window w as (partition by text_sha256 order by n desc, doc_id nulls last
                    rows between unbounded preceding and unbounded following)""",
    "op12_centroid_clustering": """
with kept as materialized (
  select row_number() over () as r, vec_id, embedding from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
comp as materialized (
  select r, d, floor(256 * x::double)::bigint as x
  from (select r, unnest(embedding) as x, generate_subscripts(embedding, 1) as d from kept)),
start as (
  select r, row_number() over (order by sha256('2:' || coalesce(vec_id::varchar, ''))) - 1 as c from kept),
c0 as materialized (select c, d, x from start join comp using (r) where c < 40),
""" + "".join(CLUSTER_ROUND.format(i=i, j=i + 1) for i in range(6)) + """
sums as (select c, sum(distance)::bigint as cluster_inertia from a5 group by c),
shas as (select c, sha256(string_agg(x::varchar, ',' order by d)) as centroid_sha256 from c5 group by c)
select vec_id, c::int as cluster, distance, cluster_inertia, (select sum(distance)::bigint from a5) as inertia, centroid_sha256
from a5 join kept using (r) join sums using (c) join shas using (c)""",
    "op13_lexical_search": r"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
sizes as (select r, doc_id, len(terms) as n from d where len(terms) > 0),
total as (select count(*) as n_docs, sum(n)::bigint as n_terms from sizes),
tf as (select r, term, count(*) as tf from (select r, unnest(terms) as term from d) group by r, term),
wanted as (
  select distinct item_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
weights as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint as w
  from (select term, count(*) as df from tf group by term), total),
scores as (
  select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::bigint as score
  from wanted join weights using (term) join tf using (term) join sizes using (r), total
  group by item_id, r, doc_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 50""",
}
