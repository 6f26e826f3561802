"""The queries op1_ ... op13_ over the whole given tables, and their SQL twins where SQL can tell."""

from __future__ import annotations

from groundspark.session import table

from . import centroids, decontaminate, hmm_lm, html_extract, mixing, pieces, secrets, simhash, substring_dedup, topk, toxicity, warc, whitening


def piece_model() -> str:
    """Place of the public merge-type vocabulary on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_html(spark, sf_dir):
    return html_extract.digests(table(spark, sf_dir, "pages"))


def op2_secrets(spark, sf_dir):
    return secrets.digests(table(spark, sf_dir, "documents"))


def op3_topk(spark, sf_dir):
    return topk.nearest_of_hundredths(table(spark, sf_dir, "embeddings"))


def op4_substring(spark, sf_dir):
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark, sf_dir):
    return pieces.digests(table(spark, sf_dir, "documents"), piece_model())


def op6_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark, sf_dir):
    return simhash.digests(table(spark, sf_dir, "documents"))


def op8_hmm(spark, sf_dir):
    return hmm_lm.scored(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark, sf_dir):
    return warc.audited(table(spark, sf_dir, "pages"))


def op11_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_centroids(spark, sf_dir):
    return centroids.digests(table(spark, sf_dir, "embeddings"))


def op13_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html": op1_html,
    "op2_secrets": op2_secrets,
    "op3_topk": op3_topk,
    "op4_substring": op4_substring,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_decontaminate": op6_decontaminate,
    "op7_simhash": op7_simhash,
    "op8_hmm": op8_hmm,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
    "op11_whitening": op11_whitening,
    "op12_centroids": op12_centroids,
    "op13_mixing": op13_mixing,
}

#: Files of 128 records have three levels. chr(13) || chr(10) is the line end of WARC.
OP10_SQL = """
with given as (
  select page_id, least(0, coalesce((select floor(min(page_id) / 128.0)::bigint from pages), 0)) - 1 - ('0x' || left(sha256(coalesce(url, '') || '|' || coalesce(html, '')), 8))::bigint % greatest(1, (select ceil(count(*) / 128.0)::bigint from pages where page_id is null)) as loose, url, html from pages),
sides as (
  select 'a' as side, page_id, loose, coalesce(url, '') as url, coalesce(html, '') as html from given
  union all
  select 'b', page_id, loose, coalesce(url, ''), case when page_id % 97 = 0 then left(coalesce(html, ''), greatest(length(coalesce(html, '')) - 1, 0)) || '~' else coalesce(html, '') end
  from given where page_id is null or page_id % 389 <> 1),
texts as (
  select side, coalesce(floor(page_id / 128)::bigint, loose) as file, coalesce(page_id, loose) as number, url,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) as t
  from sides),
recs as (
  select side, file, octet_length(encode(t)) as length, sha256(t) as digest,
    row_number() over w - 1 as leaf, sum(octet_length(encode(t))) over w - octet_length(encode(t)) as off
  from texts window w as (partition by side, file order by number, url, sha256(t))),
l0 as (select side, file, leaf as node, off::bigint as off, (off + length)::bigint as fin, sha256(off::bigint || '|' || length || '|' || digest) as seal from recs),
l1 as (select side, file, node // 16 as node, min(off) as off, max(fin) as fin, sha256(min(off) || '|' || max(fin) || '|' || string_agg(seal, '' order by node)) as seal from l0 group by side, file, node // 16),
l2 as (select side, file, node // 16 as node, min(off) as off, max(fin) as fin, sha256(min(off) || '|' || max(fin) || '|' || string_agg(seal, '' order by node)) as seal from l1 group by side, file, node // 16),
p2 as (select coalesce(a.file, b.file) as file, a.seal as ra, b.seal as rb from (select * from l2 where side = 'a') a full join (select * from l2 where side = 'b') b on a.file = b.file and a.node = b.node),
p1 as (select coalesce(a.file, b.file) as file, coalesce(a.node, b.node) as node, a.seal as ra, b.seal as rb from (select * from l1 where side = 'a') a full join (select * from l1 where side = 'b') b on a.file = b.file and a.node = b.node),
p0 as (select coalesce(a.file, b.file) as file, coalesce(a.node, b.node) as node, coalesce(a.off, b.off) as off, coalesce(a.fin, b.fin) as fin, a.seal as ra, b.seal as rb from (select * from l0 where side = 'a') a full join (select * from l0 where side = 'b') b on a.file = b.file and a.node = b.node),
s1 as (select * from p1 where file in (select file from p2 where ra is distinct from rb)),
s0 as (select p0.* from p0 join s1 on p0.file = s1.file and p0.node // 16 = s1.node where s1.ra is distinct from s1.rb),
bad as (select file, count(*) as n, list(off || '-' || fin order by off, fin) as ranges from s0 where ra is distinct from rb group by file)
select p2.file, coalesce((select count(*) from recs where side = 'a' and recs.file = p2.file), 0)::bigint as n_records,
  coalesce((select sum(length) from recs where side = 'a' and recs.file = p2.file), 0)::bigint as n_bytes,
  ra as root_primary, rb as root_replica, ra is not distinct from rb as intact,
  (1 + (select count(*) from s1 where s1.file = p2.file) + (select count(*) from s0 where s0.file = p2.file))::bigint as n_compared,
  coalesce(bad.n, 0)::bigint as n_corrupt, coalesce(bad.ranges, []::varchar[]) as ranges
from p2 left join bad on p2.file = bad.file
"""

OP3_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select * from r where rank <= 10
"""

#: One step: rows to their nearest centroid, then the centroids' floors of means. Empty ones stay.
OP12_STEP = """
d{i} as (select r, k, list_sum(list_transform(range(1, 65), lambda j: (v.e[j] - c.e[j]) * (v.e[j] - c.e[j])))::bigint as d from v, c{i} as c),
a{i} as (select r, arg_min(k, (d, k)) as k, min(d) as d from d{i} group by r)"""
OP12_MEAN = """,
s{i} as (select k, j, sum(v.e[j])::bigint as s, count(*) as n from a{i} join v on a{i}.r = v.r, range(1, 65) t(j) group by k, j),
m{i} as (select k, list(((s - ((s % n) + n) % n) // n)::bigint order by j) as e from s{i} group by k),
c{n} as (select c.k, coalesce(m.e, c.e) as e from c{i} as c left join m{i} as m on c.k = m.k),"""
OP12_SQL = (
    """
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
  where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
c0 as (select row_number() over (order by sha256('1:' || vec_id)) - 1 as k, e from v qualify row_number() over (order by sha256('1:' || vec_id)) <= 16),"""
    + "".join(OP12_STEP.format(i=i) + OP12_MEAN.format(i=i, n=i + 1) for i in range(3))
    + OP12_STEP.format(i=3)
    + """
select vec_id, a3.k::int as cluster, d as distance, (sum(d) over (partition by a3.k))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
  sha256(array_to_string(c3.e, ',')) as centroid_sha256
from a3 join v on a3.r = v.r join c3 on a3.k = c3.k
"""
)

ORACLE: dict[str, str] = {"op3_topk": OP3_SQL, "op10_warc": OP10_SQL, "op12_centroids": OP12_SQL}
