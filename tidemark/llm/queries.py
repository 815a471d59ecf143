"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.ball_kmeans import ball_kmeans
from tidemark.llm.common import Scratch, read_table
from tidemark.llm.embedding_dedup import near_vectors
from tidemark.llm.fill_middle import fill_in_middle, restored
from tidemark.llm.language_id import identify_languages
from tidemark.llm.ngram_join import jaccard_components
from tidemark.llm.packing import pack
from tidemark.llm.quality_model import quality_scores
from tidemark.llm.quality_rules import quality_rules
from tidemark.llm.sharding import byte_shards
from tidemark.llm.suffix_dedup import repeat_digest
from tidemark.llm.toxicity import toxicity_scores
from tidemark.llm.url_filter import url_verdicts
from tidemark.llm.word_bpe import encode_decode


def tokenizer_file(name: str) -> str:
    """Where the public vocabulary files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), Scratch(spark, "op1"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), Scratch(spark, "op2")).select("doc_id", "held_out", "score", "predicted")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(read_table(spark, sf_dir, "documents"), Scratch(spark, "op3"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(read_table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read_table(spark, sf_dir, "documents"), Scratch(spark, "op5"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(read_table(spark, sf_dir, "documents"), Scratch(spark, "op7"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"), Scratch(spark, "op8"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), Scratch(spark, "op9"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(read_table(spark, sf_dir, "documents"), Scratch(spark, "op11"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans(read_table(spark, sf_dir, "embeddings"), Scratch(spark, "op12")).drop("compared")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), Scratch(spark, "op13")).select("doc_id", "held_out", "score", "predicted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_quality_classifier, op3_suffix_array_dedup, op4_url_filters, op5_quality_rules,
        op6_language_id, op7_sharding, op8_embedding_near_dedup, op9_best_fit_packing, op10_bpe, op11_fill_in_middle,
        op12_centroid_clustering, op13_toxicity, pipeline,
    )
}

OP4_SQL = """
with parts as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages
), cut as (
  select page_id, regexp_extract(rest, '^[^/?#]*') as raw_host, rest from parts
), canon as (
  select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') as path from cut
), rules(verdict, rhost, rpath) as (
  values ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')
), best as (
  select c.page_id, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) as rule, arg_max(r.verdict, length(r.rhost || r.rpath)) as verdict
  from canon c join rules r on (c.host = r.rhost or ends_with(c.host, '.' || r.rhost)) and starts_with(c.path, r.rpath)
  group by c.page_id
)
select c.page_id, c.host, c.path, b.rule, coalesce(b.verdict, 'allow') as verdict
from canon c left join best b on b.page_id = c.page_id
"""

OP1_SQL = r"""
with recursive toks as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sh as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from toks
), sizes as (select doc_id, count(*) as n from sh group by 1),
bo as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select b.a, b.b from bo b join sizes x on x.doc_id = b.a join sizes y on y.doc_id = b.b where 100 * b.c >= 75 * (x.n + y.n - b.c)),
reach as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.c, d.doc_id)) as component_id
from documents d left join sizes s using (doc_id) left join (select a as doc_id, min(b) as c from reach group by 1) m using (doc_id)
"""

#: crc32 by its table, which the recursion builds from the polynomial.
OP7_SQL = r"""
with recursive bit(i, k, c) as (select i, 0, i::bigint from range(256) t(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bit where k < 8),
tab as (select list(c order by i) as t from bit where k = 8),
h as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
crc as (select doc_id, (len(h) // 2 + 1)::bigint as size, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) as text_crc32 from h, tab),
pos as (select *, sum(size) over (order by doc_id, size, text_crc32 rows unbounded preceding) as upto, sum(size) over () as total from crc),
cut as (select *, least(7, ((2 * upto - size) * 8) // (2 * total))::int as shard from pos)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by doc_id, size, text_crc32) - 1 as slot, null::int as grown_shard from cut
"""

ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard_join": OP1_SQL, "op4_url_filters": OP4_SQL, "op7_sharding": OP7_SQL}
