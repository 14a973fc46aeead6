"""The queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import secret_scan
from .byte_bpe import op8_byte_bpe
from .domain_mixing import op9_domain_mixing
from .embedding_join import op3_embedding_join
from .html_text import op4_html_text
from .minhash_join import op7_minhash_join
from .quality_rules import op2_quality_rules
from .secret_scan import op1_secret_scan
from .token_counts import op10_token_counts
from .toxicity import op6_toxicity
from .warc import op5_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_quality_rules, op3_embedding_join, op4_html_text, op5_warc, op6_toxicity, op7_minhash_join, op8_byte_bpe, op9_domain_mixing, op10_token_counts)}


_REACH = """reach(a, b) as (select a, b from linked union select r.a, l.b from reach r join linked l on r.b = l.a),
least as (select a, min(b) as b from reach group by a)"""

OP3_SQL = f"""
with recursive good as (select vec_id, embedding::double[] as v from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (select p.vec_id as a, q.vec_id as b from good p join good q on len(p.v) = len(q.v) and p.vec_id < q.vec_id and list_inner_product(p.v, q.v) / (sqrt(list_inner_product(p.v, p.v)) * sqrt(list_inner_product(q.v, q.v))) >= 0.9),
linked as (select a, b from pairs union select b, a from pairs), {_REACH}, n as (select a, count(*) as n from linked group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, least(vec_id, coalesce(l.b, vec_id)) as component_id, vec_id = least(vec_id, coalesce(l.b, vec_id)) as kept
from embeddings e left join n on n.a = vec_id left join least l on l.a = vec_id"""

OP5_SQL = f"""
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as x from pages),
d as (select page_id, strlen(h)::bigint as payload_bytes, {" || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, {1 + 10 * i}, 10))::bigint >> {35 - 5 * k}) & 31)::int + 1, 1)" for i in range(4) for k in range(8))} as payload_digest from p)
select page_id, payload_bytes, payload_digest, case when page_id = min(page_id) over w then 'response' else 'revisit' end as record_type, case when page_id <> min(page_id) over w then min(page_id) over w end as refers_to
from d window w as (partition by payload_digest)"""

OP7_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select x.doc_id as a, y.doc_id as b, count(*) as n from s x join s y on x.s = y.s and x.doc_id < y.doc_id group by all),
pairs as (select a, b from common c join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c.n >= 75 * (p.n + q.n - c.n)),
linked as (select a, b from pairs union select b, a from pairs), {_REACH}
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(l.b, d.doc_id)) as kept
from documents d left join n on n.doc_id = d.doc_id left join least l on l.a = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """The others hold trained models or tokenizers, which SQL can't express; tests hold them against brute force (op2, op9), the libraries (op8, op10) or held-out pages and documents (op4, op6)."""
    return {"op1_secret_scan": secret_scan.oracle(), "op3_embedding_join": OP3_SQL, "op5_warc": OP5_SQL, "op7_minhash_join": OP7_SQL}
