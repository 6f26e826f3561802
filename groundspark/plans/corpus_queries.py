"""Queries of the corpus building operators (B1-B16, C1-C22, D1-D6) over conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundspark.functions import text as X
from groundspark.operators import corpus as C
from groundspark.operators import metrics as M
from groundspark.operators.util import draw
from groundspark.session import table

from . import adapters as A
from .book import query

USER = ["user"]


def sql_draw(seed: int, *cols: str) -> str:
    """The SQL twin of operators.util.draw."""
    return f"('0x' || substr(md5({seed} || '|' || {' || chr(124) || '.join(c + '::varchar' for c in cols)}), 1, 8))::bigint"


TRANSCRIPTS = """
t0 as (select format('conv_{:05d}.csv', conv_id) as transcript_filename, turn as row_idx, (turn * 17 // 60) || ':' || lpad((turn * 17 % 60)::varchar, 2, '0') as time_raw, role as speaker, text as utterance, format('conv_{:05d}.mp4', conv_id) as video_name, turn * 17 as start from conversations)"""
FRAMES = (
    "with "
    + TRANSCRIPTS
    + r""",
t1 as (select * from t0 where transcript_filename in (select transcript_filename from t0 group by 1 having count(*) > 1 and count(distinct video_name) = 1)),
t2 as (select *, coalesce(lead(start) over (partition by transcript_filename order by row_idx), start) as fin from t1),
t3 as (select * from t2 where speaker = 'user'),
clean as (select *, replace(replace(regexp_replace(regexp_replace(regexp_replace(utterance, '\*[^)]*\*', '', 'g'), '\[[^)]*\]', '', 'g'), '\([^)]*\)', '', 'g'), 'inaudible', 'INAUDIBLE'), '*', '') as u from t3),
t4 as (select transcript_filename, video_name, row_idx, start, fin,
  list_filter(list_transform(string_split(regexp_replace(u, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
    lambda s: array_to_string(list_transform(regexp_extract_all(s, '[a-zA-Z0-9'']+|[.,!?;]'), lambda t: case when t = 'INAUDIBLE' then '<unk>' else lower(t) end), ' ')), lambda s: s <> '') as ss from clean),
t5 as (select transcript_filename, video_name, row_idx, start, fin, len(ss) as n, unnest(ss) as sentence, unnest(range(len(ss))) as i from t4),
t6 as (select *, trunc(start + (fin - start) * i / n)::int as s_start, trunc(start + (fin - start) * (i + 1) / n)::int as s_end,
  row_number() over (partition by transcript_filename order by row_idx, i) as utterance_num from t5),
frames as (select transcript_filename, video_name as video_filename, sentence as utterance, utterance_num, s_start,
  unnest(range(least(greatest((s_end - s_start) * 5, 1), 32))) as frame_num from t6),
named as (select transcript_filename, video_filename, utterance, s_start + frame_num / 5.0::double as timestamp, utterance_num, frame_num,
  replace(transcript_filename, '.csv', '') || format('_{:03d}_{:02d}.jpg', utterance_num, frame_num) as frame_filename from frames),
utts as (select transcript_filename, video_filename, utterance_num, first(utterance order by frame_num) as utterance, count(*)::int as num_frames, list(timestamp order by frame_num) as timestamps, list(frame_filename order by frame_filename) as frame_filenames from named group by 1, 2, 3)
"""
)


def frames(spark, sf):
    return C.preprocess(A.transcripts(spark, sf), USER)


def utterances(spark, sf):
    return C.group_utterances(frames(spark, sf))


@query("b1_timestamps", r"""
with v as (select conv_id, turn, case turn % 6 when 0 then (turn % 70) || ':' || (turn % 10) when 1 then ':' || (conv_id % 60) when 2 then (conv_id % 60)::varchar when 3 then (turn % 9) || ';' || (conv_id % 200) || '-2:00' when 4 then (turn % 9) || '.' || (turn % 7) || ' ' else 'x:yz' end as raw from conversations),
p as (select *, string_split_regex(split_part(raw, '-', 1), '[:.,;]') as parts from v)
select conv_id, turn, raw, (case when trim(parts[1]) = '' then 0 else try_cast(trim(parts[1]) as int) end) * 60 + case when parts[2] is null then 0 when parts[2] in ('1', '2', '3', '4', '5') then parts[2]::int * 10 when length(trim(parts[2])) > 2 then null else try_cast(trim(parts[2]) as int) end as seconds from p
""")
def b1_timestamps(spark, sf):
    c = table(spark, sf, "conversations")
    t, v = F.col("turn"), F.col("conv_id")
    s = lambda x: x.cast("string")
    raw = F.when(t % 6 == 0, F.concat(s(t % 70), F.lit(":"), s(t % 10))).when(t % 6 == 1, F.concat(F.lit(":"), s(v % 60))).when(t % 6 == 2, s(v % 60)).when(t % 6 == 3, F.concat(s(t % 9), F.lit(";"), s(v % 200), F.lit("-2:00"))).when(t % 6 == 4, F.concat(s(t % 9), F.lit("."), s(t % 7), F.lit(" "))).otherwise("x:yz")
    return c.select("conv_id", "turn", raw.alias("raw")).withColumn("seconds", X.parse_timestamp("raw"))


@query("b4_b6_tokens", r"""
select conv_id, turn, regexp_extract_all(lower(text), '[a-zA-Z0-9'']+|[.,!?;]') as basic, len(list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '')) as n_ws,
  list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') as alpha from conversations
""")
def b4_b6_tokens(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.tokenize_basic("text").alias("basic"), F.size(X.tokenize_ws("text")).alias("n_ws"), X.tokenize_alpha("text").alias("alpha"))


ALIAS_SQL = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in X.ALIASES.items()) + "}"
CANON_SQL = f"coalesce(({ALIAS_SQL})[t], case when t like '%es' and length(t) > 3 then left(t, length(t) - 2) when t like '%s' and length(t) > 2 then left(t, length(t) - 1) else t end)"


@query("b7_canonical_tokens", f"""
select t as token, count(*) as n, {CANON_SQL} as canon from (select unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')) as t from conversations) group by t
""")
def b7_canonical_tokens(spark, sf):
    rows = table(spark, sf, "conversations").select(F.explode(X.tokenize_alpha("text")).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("n")).withColumn("canon", X.canonical(F.col("token")))


@query("b8_b12_labels", r"""
with p as (select p_partkey, p_name, trim(regexp_replace(regexp_replace(replace(lower(p_name || '_' || p_brand), '_', ' '), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) as phrase, lower(split_part(p_name, ' ', -1)) as w from part)
select p_partkey, phrase,
  case when w like '%ies' and length(w) > 3 then left(w, length(w) - 3) || 'y' when w like '%ses' and length(w) > 3 then left(w, length(w) - 2) when w like '%s' and not w like '%ss' and length(w) > 3 then left(w, length(w) - 1) else w end as singular,
  case when length(w) <= 2 then w when regexp_matches(w, '[^aeiou]y$') then left(w, length(w) - 1) || 'ies' when regexp_matches(w, '(s|x|z|ch|sh)$') then w || 'es' else w || 's' end as plural,
  length(w) >= 3 as good, regexp_replace(regexp_replace(lower(trim(p_name)), '[ /]', '_', 'g'), '[^a-z0-9_-]', '', 'g') as safe from p
""")
def b8_b12_labels(spark, sf):
    w = F.lower(F.element_at(F.split("p_name", " "), -1))
    return table(spark, sf, "part").select("p_partkey", X.clean_phrase(F.concat_ws("_", "p_name", "p_brand")).alias("phrase"), X.singularize(w).alias("singular"), X.pluralize(w).alias("plural"), X.is_good_label(w).alias("good"), X.sanitize_label("p_name").alias("safe"))


@query("b13_b18_keys", FRAMES + r"""
select frame_filename, replace(transcript_filename, '.csv', '') as clip, utterance_num::int as utt, frame_num::int as frm, floor(timestamp * 5 + 1e-6)::bigint as frame_index, replace(frame_filename, '.jpg', '') as base,
  replace(transcript_filename, '.csv', '') || format('_{:03d}_{:02d}', utterance_num, frame_num + 3) as neighbor,
  case when frame_num >= 1 then replace(transcript_filename, '.csv', '') || format('_{:03d}_{:02d}', utterance_num, frame_num - 1) end as before, replace(frame_filename, '.jpg', '') || '_obj_ball_007' as mask, 'ball' as mask_label, 7 as mask_number from named
""")
def b13_b18_keys(spark, sf):
    f = frames(spark, sf).withColumn("base", X.frame_base("frame_filename")).withColumn("mask", F.concat("base", F.lit("_obj_ball_007")))
    name, mask = X.frame_name("frame_filename"), X.mask_filename("mask")
    return f.select("frame_filename", name["clip"].alias("clip"), name["utt"].alias("utt"), name["frm"].alias("frm"), X.frame_index(F.array("timestamp"), name["utt"], F.lit(0)).alias("frame_index"), "base", X.neighbor_key("base", 3).alias("neighbor"), X.neighbor_key("base", -1).alias("before"), "mask", mask["label"].alias("mask_label"), mask["number"].alias("mask_number"))


@query("b15_clip_uid", """
select distinct conv_id, ('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::ubigint::decimal(20, 0) as uid from (select conv_id, md5(format('conv_{:05d}', conv_id)) as h from conversations)
""")
def b15_clip_uid(spark, sf):
    return table(spark, sf, "conversations").select("conv_id").distinct().withColumn("uid", X.clip_uid(F.format_string("conv_%05d", "conv_id")))


@query("c1_c6_frames", FRAMES + "select * from named")
def c1_c6_frames(spark, sf):
    return frames(spark, sf)


@query("c2_end_times", "with " + TRANSCRIPTS + " select transcript_filename, row_idx, start::int as start, coalesce(lead(start) over (partition by transcript_filename order by row_idx), start)::int as fin from t0")
def c2_end_times(spark, sf):
    return C.add_end_time(A.transcripts(spark, sf)).select("transcript_filename", "row_idx", "start", F.col("end").alias("fin"))


@query("c7_utterances", FRAMES + "select * from utts")
def c7_utterances(spark, sf):
    return utterances(spark, sf)


@query("c8_existing_frames", FRAMES + f""", kept as (select transcript_filename, utterance_num, list(frame_filename order by frame_filename) as frame_filenames from named where {sql_draw(5, 'frame_filename')} % 4 <> 0 group by 1, 2)
select u.* exclude (frame_filenames), k.frame_filenames from utts u join kept k using (transcript_filename, utterance_num)""")
def c8_existing_frames(spark, sf):
    f = frames(spark, sf)
    return C.filter_existing_frames(C.group_utterances(f), f.select("frame_filename").where(draw(5, "frame_filename") % 4 != 0))


@query("c9_splits", FRAMES + f""", o as (select transcript_filename, utterance_num, row_number() over (order by {sql_draw(3, 'transcript_filename', 'utterance_num')}, transcript_filename, utterance_num) - 1 as i, count(*) over () as n from utts)
select transcript_filename, utterance_num, case when i < trunc(n * 0.9) then 'train' when i < trunc(n * 0.9) + trunc(n * 0.05) then 'val' else 'test' end as split from o""")
def c9_splits(spark, sf):
    u = utterances(spark, sf).select("transcript_filename", "utterance_num")
    return C.split_dataset(u, "transcript_filename", "utterance_num", seed=3)


@query("c10_random_split", f"""
with o as (select doc_id, row_number() over (order by {sql_draw(4, 'doc_id')}, doc_id) - 1 as i, count(*) over () as n from documents) select doc_id, i < trunc(n * 0.3) as first from o""")
def c10_random_split(spark, sf):
    return C.random_split(table(spark, sf, "documents").select("doc_id"), 0.3, "doc_id", seed=4)


@query("c11_split_per_category", f"""
select doc_id, source, case when row_number() over (partition by source order by {sql_draw(6, 'doc_id')}, doc_id) <= floor(count(*) over (partition by source) * 0.5) then 'dev' else 'test' end as split from documents""")
def c11_split_per_category(spark, sf):
    return C.split_per_category(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", seed=6)


@query("c12_shuffled_pairs", f"""
with a as (select p_partkey, row_number() over (order by p_partkey) as i from part), b as (select p_name, row_number() over (order by {sql_draw(7, 'p_partkey')}, p_partkey) as i from part) select p_partkey, p_name from a join b using (i)""")
def c12_shuffled_pairs(spark, sf):
    return C.shuffle_pairs(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "p_partkey", seed=7)


WS = r"list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '')"


@query("c13_vocabulary", f"select token, row_number() over (order by freq desc, token) + 3 as token_id, freq from (select token, count(*) as freq from (select unnest({WS}) as token from documents) group by token having count(*) >= 3)")
def c13_vocabulary(spark, sf):
    return C.build_vocab(table(spark, sf, "documents"), X.tokenize_ws("text"))


@query("c14_caption_vocabulary", f"select token, row_number() over (order by freq desc, token desc) + 3 as token_id, freq from (select token, count(*) as freq from (select unnest({WS}) as token from documents) group by token having count(*) > 5)")
def c14_caption_vocabulary(spark, sf):
    return C.build_caption_vocab(table(spark, sf, "documents"), X.tokenize_ws("text"))


@query("c14_caption_stats", f"""
with c as (select token, count(*) as freq from (select unnest({WS}) as token from documents) group by token)
select sum(freq)::bigint as total_tokens, count(*) as types, sum((freq <= 5)::int)::bigint as oov_types, sum(case when freq <= 5 then freq else 0 end) / sum(freq)::double as unk_rate, (select max(len({WS}))::int from documents) as max_length from c""")
def c14_caption_stats(spark, sf):
    return C.caption_stats(table(spark, sf, "documents"), X.tokenize_ws("text"))


@query("c15_event_vocabulary", """
with t as (select unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9'']+|[.,!?;]')) as token from conversations union all select unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9'']+|[.,!?;]')) from benchmark),
f as (select token, count(*) as freq from t group by token order by freq desc, token limit 29996) select token, row_number() over (order by freq desc, token) + 3 as token_id, freq from f""")
def c15_event_vocabulary(spark, sf):
    texts = table(spark, sf, "conversations").select("text").union(table(spark, sf, "benchmark").select("text"))
    return C.build_event_vocab(texts, X.tokenize_basic("text"), max_size=30_000)


VOCAB_SQL = "vocab as (select token, row_number() over (order by freq desc, token) + 3 as token_id from (select token, count(*) as freq from (select unnest(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '')) as token from conversations) group by token having count(*) >= 3))"
ENCODE_SQL = f"""with {VOCAB_SQL},
w as (select conv_id * 1000 + turn as id, list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '') as ws from conversations),
cut as (select id, %s as ws from w),
e as (select id, unnest(ws) as token, unnest(range(len(ws))) as i from cut),
ids as (select e.id, list(coalesce(token_id, 1) order by i) as ids from e left join vocab using (token) group by e.id),
raw as (select w.id, list_concat(list_concat([2], coalesce(ids, []::bigint[])), [3]) as token_ids from w left join ids using (id))
"""


@query("c16_encode_raw", ENCODE_SQL % "ws" + "select id, token_ids, len(token_ids)::int as length from raw")
def c16_encode_raw(spark, sf):
    return encoded(spark, sf, "raw")


@query("c16_encode_cut", ENCODE_SQL % "ws" + "select id, token_ids[1:25] as token_ids, len(token_ids[1:25])::int as length from raw")
def c16_encode_cut(spark, sf):
    return encoded(spark, sf, "cut")


@query("c16_encode_fixed", ENCODE_SQL % "ws[1:23]" + "select id, list_concat(token_ids, list_transform(range(25 - len(token_ids)), lambda x: 0)) as token_ids, len(token_ids)::int as length from raw")
def c16_encode_fixed(spark, sf):
    return encoded(spark, sf, "fixed")


def turns(spark, sf):
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def encoded(spark, sf, policy):
    t = turns(spark, sf)
    return C.encode_tokens(t, "id", X.tokenize_ws("text"), C.build_vocab(t, X.tokenize_ws("text")), policy)


@query("c17_decode", ENCODE_SQL % "ws" + ", d as (select id, unnest(token_ids) as token_id, unnest(range(len(token_ids))) as i from raw) select raw.id, coalesce(x.words, []::varchar[]) as words from raw left join (select id, list(case when d.token_id = 1 then '<unk>' else token end order by i) as words from d left join vocab using (token_id) where d.token_id not in (0, 2, 3) group by id) x using (id)")
def c17_decode(spark, sf):
    t = turns(spark, sf)
    vocab = C.build_vocab(t, X.tokenize_ws("text"))
    words = C.decode_tokens(C.encode_tokens(t, "id", X.tokenize_ws("text"), vocab), "id", vocab)
    return t.select("id").join(words, "id", "left").select("id", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


@query("c17_sentences", ENCODE_SQL % "ws" + ", d as (select id, unnest(token_ids) as token_id, unnest(range(len(token_ids))) as i from raw) select raw.id, coalesce(x.sentence, '') as sentence from raw left join (select id, string_agg(case when d.token_id = 1 then '<unk>' else token end, ' ' order by i) as sentence from d left join vocab using (token_id) where d.token_id not in (0, 2, 3) group by id) x using (id)")
def c17_sentences(spark, sf):
    t = turns(spark, sf)
    vocab = C.build_vocab(t, X.tokenize_ws("text"))
    ids = C.encode_tokens(t, "id", X.tokenize_ws("text"), vocab).withColumn("token_ids", F.concat("token_ids", F.array(F.lit(0), F.lit(0))))  # padded
    return C.decode_sentences(ids, "id", vocab)


def bag_sql(contiguous: bool) -> str:
    by = "('0x' || substr(md5('8|' || id || '|' || i), 1, 8))::bigint"
    many = f"list_transform(range(5), lambda i: {sql_draw(8, 'id')} % greatest(n - 4, 1) + i)" if contiguous else f"list_sort(list_transform(list_sort(list_transform(range(n), lambda i: {{'d': {by}, 'i': i}}))[1:5], lambda x: x.i))"
    return FRAMES + f""", u as (select transcript_filename || '|' || utterance_num as id, frame_filenames as f, len(frame_filenames) as n from utts)
select id, list_transform(case when n >= 5 then {many} else list_sort(list_transform(range(5), lambda i: {by} % n)) end, lambda i: f[i + 1]) as bag from u"""


def bag(spark, sf, contiguous):
    u = utterances(spark, sf).select(F.concat_ws("|", "transcript_filename", "utterance_num").alias("id"), "frame_filenames")
    return C.sample_bag(u, "id", "frame_filenames", contiguous=contiguous, seed=8).select("id", "bag")


@query("c18_bag_contiguous", bag_sql(True))
def c18_bag_contiguous(spark, sf):
    return bag(spark, sf, True)


@query("c18_bag_scattered", bag_sql(False))
def c18_bag_scattered(spark, sf):
    return bag(spark, sf, False)


@query("c19_single_frame", FRAMES + f""", u as (select transcript_filename || '|' || utterance_num as id, frame_filenames as f from utts) select id, f[{sql_draw(9, 'id')} % len(f) + 1] as frame from u""")
def c19_single_frame(spark, sf):
    u = utterances(spark, sf).select(F.concat_ws("|", "transcript_filename", "utterance_num").alias("id"), "frame_filenames")
    return C.sample_frame(u, "id", "frame_filenames", multiple=True, seed=9).select("id", "frame")


@query("c20_capped_masks", f"select frame, line from (select l_orderkey as frame, l_linenumber::bigint as line, row_number() over (partition by l_orderkey order by {sql_draw(2, 'l_orderkey', 'l_linenumber', 'l_partkey')}, l_linenumber, l_partkey) as r from lineitem join part on l_partkey = p_partkey) where r <= 3")
def c20_capped_masks(spark, sf):
    from groundspark.operators.util import cap_per_group

    d = A.detections(spark, sf)
    return cap_per_group(d, ["frame"], 3, draw(2, "frame", "line", "det_id"), F.col("line"), F.col("det_id")).select("frame", "line")


@query("c21_event_pairs", """
with f as (select o_orderkey as event, count(*) over (partition by l_orderkey) as n_frames, row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey) - 1 as idx from orders join lineitem on l_orderkey = o_orderkey),
u as (select o_orderkey as event, unnest([0, 1, 2]) as u, o_orderkey % 5 as es from orders),
v as (select event, u, es, es + u * 0.4::double as us, es + u * 0.4::double + 0.3::double as ue from u),
b as (select f.event, u, idx, least(greatest(floor((us - es) * 5), 0), n_frames - 1) as s, ue, es, n_frames from f join v using (event))
select event, u, idx from b where idx between s and least(greatest(s, ceil((ue - es) * 5)), n_frames - 1)""")
def c21_event_pairs(spark, sf):
    from pyspark.sql import Window

    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    w = Window.partitionBy("l_orderkey")
    frames_ = li.select(F.col("l_orderkey").alias("event"), F.count("*").over(w).alias("n_frames"), (F.row_number().over(w.orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")) - 1).cast("long").alias("idx"))
    u = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("u"), (F.col("o_orderkey") % 5).cast("double").alias("es"))
    u = u.withColumn("us", F.col("es") + F.col("u") * F.lit(0.4)).withColumn("ue", F.col("us") + F.lit(0.3))
    return C.pair_events(u, frames_.drop("n_frames"))


@query("c21_event_sentences", r"""
with f as (select user_id as event, count(*) as n from events group by 1),
s as (select doc_id as event, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1:4] as ss from documents),
e as (select event, unnest(range(len(ss)))::int as u, unnest(ss) as sentence from s)
select e.event, u, md5(sentence) as sentence, unnest(range(n)) as idx from e join f using (event)""")
def c21_event_sentences(spark, sf):
    """Users as events with their events as frames, documents of the same number as narration."""
    frames_ = A.frame_events(spark, sf).select(F.col("clip").alias("event"), F.col("frame_idx").alias("idx"))
    told = table(spark, sf, "documents").select(F.col("doc_id").alias("event"), F.col("text").alias("narration"))
    return C.pair_sentences(told, frames_).select("event", "u", F.md5(F.col("sentence").cast("binary")).alias("sentence"), "idx")


@query("d1_label_counts", "select label, count(*) as n from (select lower(p_type) as label from lineitem join part on l_partkey = p_partkey) group by label")
def d1_label_counts(spark, sf):
    return M.label_counts(A.detections(spark, sf), "label")


@query("d2_histogram", "with c as (select len(string_split(p_name, ' '))::int as size, count(*) as n from part group by 1) select r.size::int as size, coalesce(n, 0)::bigint as n from (select unnest(range((select max(size) + 1 from c))) as size) r left join c using (size)")
def d2_histogram(spark, sf):
    return M.histogram(table(spark, sf, "part"), F.size(F.split("p_name", " ")))


@query("d3_gini", "with c as (select event_type, user_id, count(*) as n from events group by 1, 2), r as (select *, row_number() over (partition by event_type order by n) as i from c) select event_type, round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) as gini from r group by event_type")
def d3_gini(spark, sf):
    counts = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return M.gini(counts, "n", "event_type").withColumn("gini", F.round("gini", 6))


@query("d3_lorenz", "with c as (select p_type, count(*) as n from part group by 1), r as (select row_number() over (order by n) as i, sum(n) over (order by n rows unbounded preceding) as s from c) select round(i / (select count(*) from c), 6) as x, round(s / (select sum(n) from c), 6)::double as y from r union all select 0.0, 0.0")
def d3_lorenz(spark, sf):
    counts = table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return M.lorenz(counts, "n").select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("d4_effective_number", "with c as (select event_type, count(*) as n from events group by 1), p as (select n / (select sum(n) from c)::double as p from c) select round(1 / sum(p * p), 6) as inverse, round(exp(-sum(p * ln(p))), 6) as exponential from p")
def d4_effective_number(spark, sf):
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    a, b = (M.effective_number(counts, "n", k) for k in ("inverse", "entropy"))
    return a.select(F.round("effective", 6).alias("inverse")).crossJoin(b.select(F.round("effective", 6).alias("exponential")))


@query("d5_medians", "select event_type, quantile_disc(value, 0.5) as lower_median, median(value) as median from events group by 1")
def d5_medians(spark, sf):
    return M.medians(table(spark, sf, "events"), "value", "event_type")


@query("d6_weighted_metrics", "select event_type, round(coalesce(sum(v * w) / sum(case when v is not null then w end), 0), 6) as mean, round(exp(coalesce(sum(v * w) / sum(case when v is not null then w end), 0)), 4) as perplexity from (select event_type, case when event_id % 10 <> 0 then value / 50 end as v, user_id % 4 + 1 as w from events) group by 1")
def d6_weighted_metrics(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.when(F.col("event_id") % 10 != 0, F.col("value") / 50).alias("v"), (F.col("user_id") % 4 + 1).alias("w"))
    return M.weighted_metrics(e, ["event_type"], "v", "w").select("event_type", F.round("mean", 6).alias("mean"), F.round("perplexity", 4).alias("perplexity"))
