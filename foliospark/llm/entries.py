"""Queries that apply each operator of this package to its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import bpe, chat, counting, hamming, hnsw, jaccard, language, mixing, substring, suffix
from foliospark.llm.common import table


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is; the folder is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.interleave(table(spark, sf_dir, "documents"))


def op3_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.nearest(table(spark, sf_dir, "embeddings"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) form pair k."""
    turns = table(spark, sf_dir, "conversations").withColumn("pair_id", F.floor(F.col("conv_id") / 2))
    side = F.pmod("conv_id", F.lit(2))
    pairs = chat.format_preferences(turns.where(side == 0), turns.where(side == 1))
    trained = [F.aggregate(f"{x}_mask", F.lit(0), lambda a, m: a + m["end"] - m["first"]).cast("long").alias(f"{x}_trained") for x in ("chosen", "rejected")]
    return pairs.select(F.col("pair_id").cast("long").alias("pair_id"), F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"), *[F.sha2(x, 256).alias(f"{x}_sha256") for x in ("prompt", "chosen", "rejected")], *trained)


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_passages(table(spark, sf_dir, "documents"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_hnsw, op2_mixing, op3_hamming, op4_bpe, op5_language, op6_chat, op7_suffix, op8_token_counts, op9_substring, op10_jaccard)}
ORACLE_SQL: dict[str, str] = {
    "op6_chat": """
with t as (
  select conv_id // 2 as pair_id, conv_id % 2 as side, role, text,
         row_number() over (partition by conv_id order by turn, role, text) as i,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) as shown,
         case when role = 'assistant' then length(coalesce(text, '')) + 11 else 0 end as trained
  from conversations where conv_id is not null),
a as (select * from t where side = 0), b as (select * from t where side = 1),
z as (
  select coalesce(a.pair_id, b.pair_id) as pair_id, coalesce(a.i, b.i) as i,
         a.i is null or b.i is null or a.role is distinct from b.role or a.text is distinct from b.text as differs
  from a full join b on a.pair_id = b.pair_id and a.i = b.i),
k as (select pair_id, coalesce(min(i) filter (where differs) - 1, max(i)) as n from z group by pair_id)
select k.pair_id, k.n as n_prompt_turns,
       sha256(coalesce(string_agg(shown, '' order by i) filter (where side = first_side and i <= k.n), '')) as prompt_sha256,
       sha256(coalesce(string_agg(shown, '' order by i) filter (where side = 0 and i > k.n), '')) as chosen_sha256,
       sha256(coalesce(string_agg(shown, '' order by i) filter (where side = 1 and i > k.n), '')) as rejected_sha256,
       cast(coalesce(sum(trained) filter (where side = 0 and i > k.n), 0) as bigint) as chosen_trained,
       cast(coalesce(sum(trained) filter (where side = 1 and i > k.n), 0) as bigint) as rejected_trained
from k join (select *, min(side) over (partition by pair_id) as first_side from t) t using (pair_id)
group by k.pair_id, k.n""",
    "op1_hnsw": """
with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where embedding is not null),
u as (select vec_id, e from v where len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and list_sum(list_transform(e, lambda x: x * x)) > 0),
links as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
c as (select a as vec_id, min(b) as component_id from reach group by a), n as (select a as vec_id, count(*) as n_links from links group by a)
select c.vec_id, coalesce(n.n_links, 0) as n_links, c.component_id, c.vec_id = c.component_id as kept from c left join n using (vec_id)""",
    "op7_suffix": """
with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
p as (select doc_id, b, unnest(range(1, octet_length(b) + 1)) as i from d),
w as (select doc_id, i, md5(array_slice(b, i, i + 199)) as h from p where i + 199 <= octet_length(b)),
t as (select h from w group by h having count(*) > 1),
s as (select w.doc_id, w.i from w semi join t using (h)),
m as (select p.doc_id, p.i, hex(array_slice(p.b, p.i, p.i)) as x, coalesce(max(s.i) over (partition by p.doc_id order by p.i rows between 199 preceding and current row), 0) > 0 as gone
  from p left join s on s.doc_id = p.doc_id and s.i = p.i),
r as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as starts from m),
g as (select doc_id, count(*) as n_bytes, count(*) filter (where gone) as n_removed, count(*) filter (where starts) as n_spans, string_agg(x, '' order by i) filter (where not gone) as kept from r group by doc_id)
select d.doc_id, coalesce(n_bytes, 0) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from d left join g using (doc_id)""",
    "op9_substring": r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
p as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from d),
w as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as h from p where i + 49 <= len(ws)),
f as (select h, min(doc_id) as first from w group by h),
s as (select w.doc_id, w.i from w join f using (h) where f.first < w.doc_id),
m as (select p.doc_id, p.i, p.ws[p.i] as word, coalesce(max(s.i) over (partition by p.doc_id order by p.i rows between 49 preceding and current row), 0) > 0 as gone
  from p left join s on s.doc_id = p.doc_id and s.i = p.i),
g as (select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by i) filter (where not gone) as kept from m group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join g using (doc_id)""",
    "op10_jaccard": r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^$', ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
sets as (select distinct doc_id, unnest(case when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from d),
n as (select doc_id, count(*) as n from sets group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from sets a join sets b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
half as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
links as (select a, b from half union all select b, a from half),
reach(a, b) as (select doc_id, doc_id from d union select r.a, l.b from reach r join links l on r.b = l.a)
select r.a as doc_id, coalesce(max(n.n), 0) as n_shingles, min(r.b) as component_id from reach r left join n on n.doc_id = r.a group by r.a""",
}
