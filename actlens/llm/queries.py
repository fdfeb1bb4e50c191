"""Registered queries of the training-data operators: one ``opN_<name>`` each.

Every query applies its operator, with production parameters, to its whole
table. ``ORACLES`` holds DuckDB SQL where SQL can express the result; the other
queries are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.llm import (chat, hard_negatives, language, lexical, mixing, neardup_vectors, ngram_join, pieces, quality,
                         token_counts, urls, vector_search)
from actlens.llm import pages as html_pages
from actlens.llm.common import fold_of, prepare, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__doc__, run.__name__ = fn.__doc__, name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return register


_SPACE_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint"

_OP2_SQL = rf"""
with d as (select doc_id, source, {_SPACE_WORDS} as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, ((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::bigint as weight from s),
f as (select *, sum(source_size) over () - coalesce(sum(3 * source_size) over w, 0) as left_over,
             sum(weight) over () - coalesce(sum(weight) over w, 0) as weights
      from r window w as (order by 3.0 * source_size / weight, source nulls last
                          rows between unbounded preceding and 1 preceding)),
g as (select *, 3 * source_size * weights < weight * left_over as stopped from f),
l as (select left_over as lv, weights as lw from g where not stopped
      order by 3.0 * source_size / weight, source nulls last limit 1),
t as (select source, source_size, case when stopped then (3 * source_size)::double
             else (weight * lv)::double / lw::double end as target from g left join l on true),
o as (select d.doc_id, d.source, d.size, t.source_size, t.target, round(t.target)::bigint as quota,
             coalesce(sum(d.size) over (partition by d.source order by
                 md5('mix-1:' || coalesce(d.doc_id::varchar, '')), d.doc_id, d.size
                 rows between unbounded preceding and 1 preceding), 0)::bigint as b
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       case when source_size = 0 then 0::bigint else (quota // source_size * size
            + greatest(0, least(b + size, quota % source_size) - b))::bigint end as taken
from o"""


@_query("op2_mix_sources", _OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (mixing.mix_sources(read_table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "source_size", "target", "taken"))


#: conversation -7 of the contract
CONTROL_TEXT = "</s>[INST] ok [/INST]"

_ESC = (r"regexp_replace(regexp_replace({0}, '(<)(\\*)(\||/?s>|</?SYS>>)', '\1\\\2\3', 'g'), "
        r"'(\[)(\\*)(/?INST\])', '\1\\\2\3', 'g')")
_OP4_SQL = rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all values (-7::bigint, 0::bigint, 'user', '{CONTROL_TEXT}'),
                            (-7::bigint, 1::bigint, 'assistant', '{CONTROL_TEXT}')),
f as (select *, '<|turn|>' || replace({_ESC.format('role')}, chr(10), '<|nl|>') || chr(10)
             || {_ESC.format('text')} || '<|end|>' || chr(10) as formatted from c)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, formatted)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, formatted)
                       filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length(formatted))::bigint as formatted_chars
from f group by conv_id"""


@_query("op4_chat_format", _OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"),
                 F.lit(role).alias("role"), F.lit(CONTROL_TEXT).alias("text"))
        for i, role in enumerate(("user", "assistant"))])))
    parts = turns.unionByName(extra).withColumn("parts", chat.text_parts(F.col("text")))
    return chat.read_back(chat.format_turns(parts))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_OP7_RULES = ", ".join(
    f"({_sql_text(r.name)}, {_sql_text(r.regex)}, '{r.action}', '{r.kind}')" for r in urls.DEFAULT_RULES)
_OP7_SQL = rf"""
with rules(rule, regex, action, kind) as (values {_OP7_RULES}),
p as (select page_id, coalesce(url, '') as u from pages),
q as (select page_id, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path,
             row_number() over () as n from p),
m as (select n, rule, action, kind from q join rules on regexp_matches(host || path, regex)),
s as (select n, arg_max(rule, (length(rule), rule)) as rule, arg_max(action, (length(rule), rule)) as action
      from m where kind = 'site' group by n),
w as (select n, max(action = 'block') as block from m where kind = 'pattern' group by n)
select page_id, host, path, s.rule as rule,
       coalesce(s.action, case when w.block then 'block' else 'allow' end) as verdict
from q left join s using (n) left join w using (n)"""


@_query("op7_url_filter", _OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (urls.judge_urls(read_table(spark, sf_dir, "pages"))
            .select("page_id", "host", "path", "rule", "verdict"))


@_query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = fold_of(F.col("doc_id"), 4)
    model = language.fit_languages(docs, fold != 2)
    return (language.predict_languages(docs.select("doc_id", "text"), model, score_column="score")
            .select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"))


@_query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by compiled rules."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = fold_of(F.col("doc_id"), 5)
    model = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"), fold != 0)
    return (quality.score_quality(docs, model, "score")
            .select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")))


@_query("op6_html_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_pages.extract_pages(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@_query("op9_sentencepiece")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentation of every document, decoded again."""
    return pieces.encode_documents(read_table(spark, sf_dir, "documents"), pieces.load_pieces())


_OP10_SQL = """
with recursive v as (select vec_id, embedding::double[] as x, sqrt(list_inner_product(embedding::double[], embedding::double[])) as n
                     from embeddings),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
      and list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.95),
r as (select vec_id as node, vec_id as root from v
      union select l.b, r.root from r join l on l.a = r.node),
c as (select node, min(root) as component_id from r group by node),
d as (select a, count(*)::bigint as n_links from l group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from v join c on node = vec_id left join d on a = vec_id"""


@_query("op10_embedding_near_dedup", _OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


@_query("op8_vector_search")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every 20th vector."""
    return vector_search.search_vectors(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


_OP3_SQL = r"""
with recursive w as (select row_number() over () as u, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select u, doc_id, case when len(ws) between 1 and 4 then [array_to_string(ws, ' ')]
             else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as sh
      from w),
n as (select u, doc_id, len(sh)::bigint as n from s),
e as (select u, unnest(sh) as shingle from s),
i as (select a.u as a, b.u as b, count(*) as shared from e a join e b on a.shingle = b.shingle and a.u < b.u group by a.u, b.u),
l as (select a, b from i join n x on x.u = a join n y on y.u = b where 100 * shared >= 75 * (x.n + y.n - shared)),
k as (select a, b from l union all select b, a from l),
r as (select u as node, u as root from n union select k.b, r.root from r join k on k.a = r.node),
c as (select node, min(n.doc_id) as component_id from r join n on n.u = r.root group by node)
select doc_id, n as n_shingles, component_id from n join c on c.node = n.u"""


@_query("op3_ngram_join", _OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of 0.75 or more."""
    return ngram_join.ngram_components(read_table(spark, sf_dir, "documents"))


_OP11_SQL = """
with v as (select row_number() over () as uid, vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label,
                  list_transform(embedding, lambda x: floor(256 * x::double)) as q
           from embeddings where vec_id is not null and label is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select a.uid, a.vec_id as anchor_id, a.label, a.q, b.vec_id as positive_id,
             list_inner_product(a.q, b.q)::bigint as positive_score,
             row_number() over (partition by a.uid order by list_inner_product(a.q, b.q)::bigint desc, b.vec_id) as slot
      from v a join v b on a.label = b.label and a.uid <> b.uid where a.vec_id % 100 = 0 qualify slot <= 5),
n as (select p.uid, slot, anchor_id, positive_id, positive_score, v.vec_id as negative_id,
             list_inner_product(p.q, v.q)::bigint as negative_score
      from p join v on p.label <> v.label where 30 * positive_score <= 100 * list_inner_product(p.q, v.q)::bigint
        and 100 * list_inner_product(p.q, v.q)::bigint <= 90 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from (
  select *, (row_number() over (partition by uid, slot order by negative_score desc, negative_id))::int as rank from n)
where rank <= 10"""


@_query("op11_hard_negatives", _OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every 100th vector, by the scores of its positives."""
    return hard_negatives.mine_negatives(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@_query("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; the vocabulary's library is the test's reference."""
    import public_tokenizers
    table = token_counts.load_merges(public_tokenizers.path(token_counts.MODEL_NAME))
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), table)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
         r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_OP12_SQL = rf"""
with d as (select row_number() over () as u, doc_id, {_TERMS} as ts from documents),
t as (select u, doc_id, len(ts)::bigint as n, unnest(ts) as term from d),
g as (select count(distinct u)::bigint as docs, count(*)::bigint as terms from t),
f as (select u, doc_id, n, term, count(*)::bigint as tf from t group by u, doc_id, n, term),
e as (select term, count(*)::bigint as df from f group by term),
w as (select term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint as w from e, g),
q as (select i, item_id, unnest(list_distinct(ts)) as term
      from (select row_number() over () as i, item_id, {_TERMS} as ts from benchmark)),
s as (select i, item_id, u, doc_id,
             sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::bigint as score
      from q join f using (term) join w using (term), g where doc_id is not null group by i, item_id, u, doc_id)
select item_id, rank, doc_id, score from (
  select *, (row_number() over (partition by i order by score desc, doc_id))::int as rank from s where score > 0)
where rank <= 10"""


@_query("op12_lexical_search", _OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
