"""The corpus operators' queries, each over its whole tables, and SQL where SQL can express them.

Besides the ten queries there are some that hold the part of an operator's rows
that SQL can express: base statistics, host and path rules, targets and counts.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import documents, materialize, word_count
from waymark.llm.embedding_dedup import near_vectors
from waymark.llm.language_id import page_languages
from waymark.llm.lm_score import score
from waymark.llm.mixing import mix
from waymark.llm.near_dedup import near_groups
from waymark.llm.packing import pack_apart
from waymark.llm.quality import STATISTICS, quality
from waymark.llm.token_counts import Rollup, deltas, token_counts
from waymark.llm.toxicity import toxicity
from waymark.llm.url_rules import labelled_urls, url_verdicts

#: The folder of public tokenizer files, and the file of ranks in it.
TOKENIZERS, RANKS = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before that file's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer(folder: str = TOKENIZERS, file: str = RANKS, pattern: str = PATTERN) -> tuple[bytes, str]:
    """The ranks, as the file has them, and the pattern of the byte-level BPE in ``folder``."""
    return (Path(folder) / file).read_bytes(), pattern


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), width=4)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_languages(_table(spark, sf_dir, "pages"), documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and base rules of op5."""
    return op5_quality_rules(spark, sf_dir).select("doc_id", *STATISTICS, "base_failed")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_apart(documents(spark, sf_dir))


def pack_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and words of each document in the bins of op6, and the most words in any bin that holds a piece of it."""
    pieces = materialize(op6_pack(spark, sf_dir))
    bins = pieces.groupBy("shard", "bin").agg(F.sum("n_tokens").alias("held"))
    over = F.count_if(F.col("held") > 2048).alias("overfull_bins")
    return pieces.join(bins, ["shard", "bin"]).groupBy("doc_id").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_words"), F.max("start").alias("last_start"), over)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_verdicts(pages, labelled_urls(pages, _table(spark, sf_dir, "labels")))


def url_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of op7, and its verdict where a rule gives it."""
    return op7_url_filters(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), weights=(5, 2, 1), share=1.5, most=2.0)


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op9, with whether a document takes more than twice its words."""
    mixed = op9_mix_sources(spark, sf_dir)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("taken") > 2 * F.col("size")).alias("too_much"))


def op10_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Totals after three batches: all documents; the toxic ones deleted; those of poor quality counted anew by words."""
    ranks, pattern = tokenizer(tokenizers)
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").distinct()
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", "text", word_count("text").alias("words"))
    counted = materialize(token_counts(docs, ranks, pattern))
    rollup = Rollup(spark)
    rollup.commit("load", deltas(counted, "byte_bpe_50k", 1))
    rollup.commit("toxic", deltas(counted.join(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi"), "byte_bpe_50k", -1))
    poor = counted.join(labels.where("quality = 0 and toxic = 0").select("doc_id").distinct(), "doc_id", "left_semi")
    rollup.commit("recount", deltas(poor, "byte_bpe_50k", -1).unionByName(deltas(poor, "words", 1, "words")))
    rollup.commit("load", deltas(counted, "byte_bpe_50k", 1))  # a replay, which changes nothing
    return rollup.totals()


def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each total of op10, and the tokens where these are words."""
    return op10_token_counts(spark, sf_dir).select("source", "lang", "tokenizer", "docs", F.when(F.col("tokenizer") == "words", F.col("tokens")).alias("words"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """reach as (select id, id as seen from nodes union select r.id, l.b from reach r join links l on l.a = r.seen),
least as (select id, min(seen) as component_id from reach group by id)"""
_RULES = "(values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) r(verdict, host, path)"

_ORACLES = {
    # All pairs that share a shingle, and links on whole sets.
    "op1_minhash_dedup": rf"""with recursive w as (select doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
nodes as (select doc_id as id from documents), {_REACH}
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from documents d join least on least.id = d.doc_id left join n on n.doc_id = d.doc_id""",
    # All pairs of a label.
    "op8_embedding_dedup": f"""with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings where label is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98),
nodes as (select vec_id as id from embeddings), {_REACH}
select vec_id, (select count(*) from links where a = vec_id) as n_links, component_id, vec_id = component_id as kept from embeddings join least on id = vec_id""",
    "quality_base": rf"""with w as (select doc_id, text, {_WORDS} as w from documents),
t as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as t from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
twice as (select doc_id, t from t group by doc_id, t having count(*) > 1),
covered as (select doc_id, count(distinct i + k) as n from t join twice using (doc_id, t), range(3) r(k) group by doc_id),
lines as (select doc_id, l from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as l from w) where regexp_matches(l, '[^\x20\x09-\x0D]')),
again as (select doc_id, count(*) - count(distinct l) as n from lines group by doc_id),
b as (select w.doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(again.n, 0) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words
 from w left join again using (doc_id) left join covered using (doc_id))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b""",
    "pack_totals": f"select doc_id, cast(ceil(n / 2048) as bigint) as n_pieces, n as n_words, cast((ceil(n / 2048) - 1) * 2048 as bigint) as last_start, 0 as overfull_bins from (select doc_id, len({_WORDS}) as n from documents) where n > 0",
    "url_host_rules": rf"""with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, regexp_extract(rest, '^[^/?#]*') as own, rest from u),
p as (select page_id, translate(own, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(own) + 1), '^[^?#]*') as path from h),
m as (select p.page_id, r.host || r.path as rule, verdict, row_number() over (partition by p.page_id order by length(r.host || r.path) desc) as k from p, {_RULES} where (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path))
select p.page_id, host, path, rule, verdict as rule_verdict from p left join m on m.page_id = p.page_id and k = 1""",
    # The level of the targets by trying the sources that are filled one after another.
    "mix_targets": f"""with d as (select doc_id, source, len({_WORDS}) as size from documents),
s as (select source, sum(size) as n, row_number() over (order by source nulls last) - 1 as place from d group by source),
c as (select source, cast(n as double) as n, 2.0 * n as cap, ([5.0, 2.0, 1.0])[1 + place % 3] as w from s),
levels as (select x.cap / x.w as ratio, (select 1.5 * sum(n) from c) as total, (select coalesce(sum(cap), 0) from c y where y.cap / y.w < x.cap / x.w) as filled, (select sum(w) from c y where y.cap / y.w >= x.cap / x.w) as weight from c x),
level as (select arg_min((total - filled) / weight, ratio) as level from levels where (total - filled) / weight < ratio)
select d.doc_id, d.size, cast(c.n as bigint) as source_size, round(least(c.cap, coalesce((select level from level) * c.w, c.cap)), 3) as target, false as too_much from d join c on d.source is not distinct from c.source""",
    "rollup_counts": f"""with d as (select documents.doc_id, source, lang, len({_WORDS}) as words, coalesce(bool_or(toxic = 1), false) as toxic, coalesce(bool_or(quality = 0 and toxic = 0), false) as poor from documents left join labels on labels.doc_id = documents.doc_id group by documents.doc_id, source, lang, text)
select source, lang, 'byte_bpe_50k' as tokenizer, count(*) as docs, null::bigint as words from d where not toxic and not poor group by source, lang
union all select source, lang, 'words', count(*), cast(sum(words) as bigint) from d where poor group by source, lang""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ten = (op1_minhash_dedup, op2_toxicity, op3_lm_score, op4_language_id, op5_quality_rules, op6_pack, op7_url_filters, op8_embedding_dedup, op9_mix_sources, op10_token_counts)
    parts = (quality_base, pack_totals, url_host_rules, mix_targets, rollup_counts)
    return {f.__name__: f for f in (*ten, *parts)}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
