"""The thin queries over the corpus tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, embedding_dedup, license_scan, mixing, quality, sharding, simhash, suffix_dedup, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= QUALITY_BOUND).cast("int").alias("predicted"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive(table(spark, sf_dir, "pages"), min_bytes=0)
    page = lambda c: F.regexp_replace(c, "^urn:page:", "").cast("long")
    return warc.read(spark, path).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 24)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2j and 2j + 1 are the chosen and the rejected one of pair j."""
    pairs = chat_format.format_preferences(table(spark, sf_dir, "conversations"), F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0)
    return pairs.withColumns({c: chat_format.mask_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), 1.5)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 400)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and item that align: only contaminated documents appear."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Documents below this score are rejected.
QUALITY_BOUND = 0.3
QUERIES = {f.__name__: f for f in (op1_quality, op2_warc, op3_sharding, op4_chat_formatting, op5_simhash, op6_mixing, op7_embedding_dedup, op8_license_scan, op9_suffix_dedup, op10_decontaminate)}

OP2_SQL = r"""
with p as (select page_id, coalesce(html, '') as body from pages),
h as (select *, strlen(body)::bigint as payload_bytes, sha1(body) as hex, min(page_id) over (partition by body) as first from p),
d as (select *, list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(((('0x' || hex[1 + 10 * (i // 8) : 10 + 10 * (i // 8)])::bigint >> (35 - 5 * (i % 8))) & 31) + 1)::int]) as digits from h)
select page_id, payload_bytes, array_to_string(digits, '') as payload_digest,
       case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
       case when first is not null and page_id is distinct from first then first end as refers_to
from d
"""

#: CRC-32 is made from its table; the rest is one order over all rows.
OP3_SQL = r"""
with crc_table as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end, i::bigint)) as tab),
d as (select doc_id, strlen(coalesce(text, ''))::bigint + 8 as size,
             xor(list_reduce(list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda b: ('0x' || b)::bigint), lambda c, b: xor(c >> 8, tab[((xor(c, b) & 255) + 1)::int]), 4294967295::bigint), 4294967295::bigint) as crc,
             ('0x' || substr(md5(coalesce(text, '')), 1, 15))::bigint as k1, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as k2
      from documents, crc_table),
o as (select *, sum(size) over (order by k1, k2, doc_id nulls first, size rows unbounded preceding) - size as pos, sum(size) over (partition by k1) as g_bytes, sum(size) over () as total from d),
g as (select *, min(pos) over (partition by k1) as g_pos from o),
s as (select *, least(23, floor((case when g_bytes <= 0.01::double * total / 24 then 2 * g_pos + g_bytes else 2 * pos + size end * 24)::double / (2.0::double * total)))::int as shard from g)
select doc_id, size, crc as text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by pos, size) - 1 as slot, null::int as grown_shard from s
"""

OP4_SQL = r"""
with raw as (
  select conv_id // 2 as pair_id, conv_id % 2 = 0 as side, coalesce(role, 'unknown') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, 'unknown'), coalesce(text, '')) - 1 as i
  from conversations where conv_id is not null),
t as (select *, regexp_replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') as safe_role, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') as safe_text from raw),
same as (
  select a.pair_id, a.i from t a join t b on a.pair_id = b.pair_id and a.i = b.i and a.side and not b.side and a.role = b.role and a.text = b.text),
runs as (select pair_id, i, row_number() over (partition by pair_id order by i) - 1 as k from same),
pre as (select pair_id, count(*) filter (i = k) as n from runs group by pair_id),
u as (
  select t.*, coalesce(pre.n, 0) as n, '<|' || safe_role || '|>' || chr(10) || safe_text || '<|end|>' || chr(10) as body,
         (length(safe_role) + 5)::varchar || ':0,' || (length(safe_text) + 8)::varchar || case when role = 'assistant' then ':1' else ':0' end as mask
  from t left join pre using (pair_id))
select pair_id, bool_or(side) and bool_or(not side) as complete, any_value(n)::bigint as n_prompt,
       coalesce(string_agg(body, '' order by i) filter (side and i < n), '') as prompt,
       coalesce(string_agg(body, '' order by i) filter (side and i >= n), '') as chosen,
       coalesce(string_agg(body, '' order by i) filter (not side and i >= n), '') as rejected,
       coalesce(string_agg(mask, ',' order by i) filter (side and i >= n), '') as chosen_mask,
       coalesce(string_agg(mask, ',' order by i) filter (not side and i >= n), '') as rejected_mask
from u group by pair_id
"""

OP6_SQL = r"""
with d as (
  select doc_id, case when source is null then '1' else '0' || source end as sk,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, length(coalesce(text, '')) as n,
         length(translate(coalesce(text, ''), '#$%&*+=@^_|<>[]{}/~0123456789', '')) as n_plain,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))), 1, 13))::bigint as u
  from documents),
q as (select *, n_plain::double / n::double as plain from d),
k as (select *, -ln((u + 0.5::double) / 4503599627370496::double) / case when size = 0 then 1.0::double else (0.01::double + 0.99::double * plain * plain) / (1.0::double + abs(n::double / size::double - 6.0::double)) end as e from q),
s as (select sk, sum(size)::bigint as s_size from k group by sk),
w as (select *, [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by sk) - 1) % 3 + 1)::int] as w, s_size::double * 2.0::double as cap from s),
r as (select *, cap / w as ratio from w),
l as (select *, (sum(s_size) over ()::double * 1.5::double - (sum(cap) over (order by ratio, sk rows unbounded preceding) - cap))
                / (sum(w) over () - sum(w) over (order by ratio, sk rows unbounded preceding) + w) as lvl from r),
f as (select *, (select lvl from l where lvl <= ratio order by ratio, sk limit 1) as free from l),
a as (select sk, s_size, case when free is null then cap else least(cap, free * w) end as target from f),
b as (select *, case when s_size = 0 then 0 else floor(target / s_size::double) end as epochs from a),
p as (select k.*, b.s_size, b.target, b.epochs, b.target - b.epochs * b.s_size as rest,
             sum(size) over (partition by k.sk order by e, doc_id nulls first, size rows unbounded preceding) - size as before_
      from k join b on k.sk = b.sk)
select doc_id, size, s_size as source_size, target, (size * (epochs + case when 2 * before_ + size <= 2 * rest and rest > 0 then 1 else 0 end))::bigint as taken from p
"""


OP7_SQL = r"""
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
f as (select vec_id, label, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, x: a + x)) as n from v
      where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from f a join f b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r(a, c) as (select a, b from l union select r.a, l.b from r join l on r.c = l.a),
c as (select a, min(c) as least_c from r group by a),
k as (select a, count(*) as n_links from l group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, least(vec_id, coalesce(least_c, vec_id))::bigint as component_id, vec_id = least(vec_id, coalesce(least_c, vec_id)) as kept
from v left join c on c.a = vec_id left join k on k.a = vec_id
"""


def _op8_sql(drift: int = 4) -> str:
    kinds = license_scan.templates()
    pairs = ", ".join(f"({t.number}, {i}, '{t.words[i]} {t.words[i + 1]}')" for t in kinds for i in t.voting)
    rows = ", ".join(f"({t.number}, {str(t.is_base).lower()}, '{t.label}', {len(t.voting)}, {list(t.required)}::int[])" for t in kinds)
    return rf"""
with k(tid, is_base, label, n_pairs, required) as (values {rows}),
v(tid, tpos, pair) as (values {pairs}),
d as (select row_number() over () as rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words from documents),
g as (select rid, unnest(list_zip(words[:-2], words[2:])) as z, generate_subscripts(words[2:], 1) - 1 as pos from d where len(words) > 1),
h as (select rid, tid, pos - tpos as diag, list(tpos) as ts, count(*) as votes from g join v on g.z[1] || ' ' || g.z[2] = v.pair group by all),
j as (select *, coalesce(max(votes) over (partition by rid, tid order by diag range between {drift} preceding and 1 preceding), 0) as above,
             coalesce(max(votes) over (partition by rid, tid order by diag range between 1 following and {drift} following), 0) as below_,
             flatten(list(ts) over (partition by rid, tid order by diag range between {drift} preceding and {drift} following)) as near from h),
m as (select rid, diag, votes, k.*, list_distinct(case when is_base then ts else near end) as ts from j join k using (tid) where is_base or (above < votes and below_ <= votes)),
c as (select *, case when list_has_all(ts, required) and (not is_base or votes = n_pairs) then len(ts)::double / n_pairs::double else 0.0::double end as cover from m),
o as (select *, cover >= case when is_base then 1.0::double else 0.6::double end as ok from c)
select doc_id, len(words)::bigint as n_words, count(*) filter (ok and is_base) as n_base,
       (min(diag) filter (ok and is_base))::bigint as first_word, (max(diag) filter (ok and is_base))::bigint as last_word,
       coalesce(string_agg(distinct label, ',' order by label) filter (ok and is_base), '') as base_labels,
       coalesce(string_agg(distinct label, ',' order by label) filter (ok), '') as labels,
       coalesce(max(cover), 0.0::double) as score
from d left join o on d.rid = o.rid group by d.rid, doc_id, words
"""


ORACLE_SQL = {"op2_warc": OP2_SQL, "op3_sharding": OP3_SQL, "op4_chat_formatting": OP4_SQL, "op6_mixing": OP6_SQL, "op7_embedding_dedup": OP7_SQL, "op8_license_scan": _op8_sql()}
