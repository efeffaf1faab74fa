"""The queries that apply these operators to their whole tables, and SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.common import documents
from tidemill.llm.decontamination import decontaminate
from tidemill.llm.exact_dedup import exact_dedup
from tidemill.llm.html_text import extract_text
from tidemill.llm.language_id import predict_language, train_tagger
from tidemill.llm.ngram_join import ngram_join
from tidemill.llm.packing import pack_along_curve
from tidemill.llm.quality import fit_quality, score_quality
from tidemill.llm.sharding import interleaved_shards
from tidemill.llm.substring_dedup import substring_dedup
from tidemill.llm.warc import read_archives, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_along_curve(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_quality(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved_shards(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict_language(docs, train_tagger(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_curve_packing, op2_exact_dedup, op3_html_text, op4_ngram_join, op5_quality, op6_decontamination, op7_warc, op8_substring_dedup, op9_sharding, op10_language_id)
    return {f.__name__: f for f in found}


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n
"""

OP4 = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
reach(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, l.b from reach r join links l on l.a = r.other)
select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.other) as component_id
from documents d left join n on n.doc_id = d.doc_id join reach r on r.doc_id = d.doc_id group by d.doc_id
"""

OP6 = rf"""
with b as (select cast(item_id as varchar) as item, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (
  select distinct item, unnest(case when len(w) = 0 then [] when len(w) < 10 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i+9], ' ')) end) as g from b),
sized as (select distinct g, len(string_split(g, ' ')) as k from win),
d as (select doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
spot as (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from sized)),
hit as (select doc_id, i, spot.k, sized.g from spot join sized on sized.k = spot.k and sized.g = array_to_string(w[i:i+spot.k-1], ' ')),
word as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hit) group by doc_id),
item as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
         from (select distinct doc_id, item from hit join win using (g)) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join word using (doc_id) left join item using (doc_id)
"""

OP7 = r"""
with p as (select page_id, coalesce(html, '') as h from pages),
g as (select *, min(page_id) over (partition by h) as first, sha1(h) as x from p)
select page_id, cast(strlen(h) as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((cast('0x' || substr(x, 1 + 5 * (k // 4), 5) as bigint) >> (15 - 5 * (k % 4))) & 31)::int, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from g
"""

OP8 = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, unnest(range(1, len(w) - 18)) as i, w from w where len(w) >= 20),
again as (select doc_id, i, row_number() over (partition by array_to_string(w[i:i+19], ' ') order by doc_id, i) > 1 as a from win),
gone as (select doc_id, list(distinct p) as gone from (select doc_id, unnest(range(i, i + 20)) as p from again where a) group by doc_id),
word as (select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as word from w),
removed as (select distinct doc_id, unnest(gone) as p from gone),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as body from word anti join removed using (doc_id, p) group by doc_id)
select w.doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(body, '')) as kept_sha256
from w left join kept using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """The others can't be put in SQL: their tests are against brute force or held-out labels."""
    return {"op2_exact_dedup": OP2, "op4_ngram_join": OP4, "op6_decontamination": OP6, "op7_warc": OP7, "op8_substring_dedup": OP8}
