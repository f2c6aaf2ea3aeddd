"""The corpus operators' queries: each applies its operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chunking, mixing, negatives, packing, periodic, setjoin, sharding, simhash, substrings, tiff, token_counts, toxicity, url_filter
from .common import table


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_packing(spark, sf_dir):
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), tokenizer_file()))


def op3_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file())


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = (toxicity.fold_of(F.col("doc_id")) == 0).alias("held_out")
    return toxicity.score(docs, table(spark, sf_dir, "labels")).select("doc_id", held_out, "score", "predicted", F.to_json("evidence").alias("evidence"))


def op5_substring_dedup(spark, sf_dir):
    return substrings.digests(substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_chunk_fingerprints(spark, sf_dir):
    return chunking.compare_with_next(table(spark, sf_dir, "documents"))


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_tiff(spark, sf_dir):
    return tiff.round_trip(table(spark, sf_dir, "documents"))


def op10_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sharding.shard(docs.select("doc_id", "source", F.length("text").cast("long").alias("n_chars")))


def op11_periodic_runs(spark, sf_dir):
    return periodic.digests(periodic.detect(periodic.with_periods(table(spark, sf_dir, "documents"))))


def op12_jaccard_join(spark, sf_dir):
    return setjoin.link_components(table(spark, sf_dir, "documents"))


def relabelled(rows):
    """The embeddings that op13 mines: of every seventh id the label that follows."""
    label = F.col("label").cast("long")
    return rows.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), "embedding")


def op13_hard_negatives(spark, sf_dir):
    return negatives.mine(relabelled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_packing": op2_packing,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_chunk_fingerprints": op6_chunk_fingerprints,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_tiff": op9_tiff,
    "op10_sharding": op10_sharding,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {
    "op1_url_filter": r"""
with p as (
  select page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
q as (
  select *, case when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
                 when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
                 when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
                 when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
                 when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule
  from p)
select page_id, host, path, rule, case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict from q
""",
    "op5_substring_dedup": r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
win as (select doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) as k from (select doc_id, w, unnest(generate_series(1, len(w) - 49)) as p from d where len(w) >= 50)),
first as (select k, min(doc_id) as least from win group by k having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, p + unnest(generate_series(0, 49)) as pos from win join first using (k) where doc_id > least),
word as (select doc_id, unnest(w) as x, unnest(generate_series(1, len(w))) as pos from d where len(w) > 0),
kept as (select word.doc_id, string_agg(word.x, ' ' order by word.pos) as t from word left join gone using (doc_id, pos) where gone.pos is null group by word.doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(g.n, 0) as bigint) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from d left join kept using (doc_id) left join (select doc_id, count(*) as n from gone group by doc_id) g using (doc_id)
""",
    "op10_sharding": f"""
with t as (select [{", ".join(map(str, sharding.fill()))}] as owner),
d as (select doc_id, source, length(text) as n_chars, cast(cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) % {sharding.SLOTS} as int) as slot from documents)
select doc_id, source, n_chars, slot, 'shard-' || lpad(cast(owner[slot + 1] as varchar), 3, '0') as shard from d, t
""",
    "op11_periodic_runs": r"""
with crc as (select list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) order by k) as t from (select unnest(range(256)) as k)),
src as (
  select row_number() over () as r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1]))) as h
  from documents, crc),
cut as (select r, doc_id, w, len(w) as n, h, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) else len(w) end as a from src),
per as (select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from cut),
word as (select r, n, pos, case when pos < a then w[pos + 1] else w[a + (pos - a) % p + 1] end as x from (select *, unnest(range(n)) as pos from per)),
pair as (select l.r, l.pos, k.pos - l.pos as q from word l join word k on l.r = k.r and l.x = k.x and k.pos > l.pos and 3 * (k.pos - l.pos) <= l.n),
hit as (select r, q from pair group by r, q having count(*) >= greatest(24 - q, 2 * q)),
isle as (select r, q, pos, pos - row_number() over (partition by r, q order by pos) as g from pair join hit using (r, q)),
stretch as (select r, q, min(pos) as s, count(*) + q as len from isle group by r, q, g having count(*) >= greatest(24 - q, 2 * q)),
run as (select r, s, len, min(q) as q from stretch group by r, s, len),
sums as (
  select r, count(*) as n_runs, sha256(string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q)) as runs_sha256,
         first(struct_pack(s := s, len := len, q := q) order by 1.0::double * len / q desc, s, q) as best
  from run group by r),
gone as (select distinct r, unnest(range(s + q, s + len)) as pos from run),
kept as (select r, string_agg(x, ' ' order by pos) as t from word anti join gone using (r, pos) group by r)
select doc_id, n as n_words, coalesce(n_runs, 0) as n_runs, best.s as start, best.len as length, best.q as period, 1000 * best.len // best.q as exponent_milli,
       coalesce(runs_sha256, sha256('')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from per left join sums using (r) left join kept using (r)
""",
    "op12_jaccard_join": r"""
with recursive d as (
  select row_number() over () as r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents),
sh as (select distinct r, array_to_string(w[k:k + 3], ' ') as s from (select r, w, unnest(range(1, greatest(len(w) - 2, 2))) as k from d where len(w) > 0)),
size as (select r, count(*) as n from sh group by r),
shared as (select a.r as x, b.r as y, count(*) as o from sh a join sh b using (s) where a.r < b.r group by a.r, b.r),
link as (select x, y from shared join size a on a.r = x join size b on b.r = y where 100 * o >= 85 * (a.n + b.n - o)),
edge as (select x, y from link union all select y, x from link),
reach as (select r, r as y from d union select reach.r, edge.y from reach join edge on edge.x = reach.y)
select a.doc_id, coalesce(any_value(n), 0) as n_shingles, min(b.doc_id) as component_id
from d a join reach using (r) join d b on b.r = reach.y left join size on size.r = a.r group by a.r, a.doc_id
""",
    "op13_hard_negatives": r"""
with e as (
  select vec_id, case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id, b.label = a.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
  from e a cross join e b where a.vec_id % 50 = 0),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same and vec_id <> anchor_id
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (
  select anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score,
         row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank
  from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 3
""",
    "op8_mixing": rf"""
with d as (select doc_id, source, cast(len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])) as bigint) as size,
  md5(coalesce(cast(doc_id as varchar), '') || '|7|' || coalesce('=' || source, '') || '|' || coalesce(text, '')) as m from documents),
n as (select doc_id, source, size, cast('0x' || substr(m, 1, 15) as bigint) as h, cast('0x' || substr(m, 16, 15) as bigint) as h2 from d),
s as (select source, cast(sum(size) as bigint) as l, row_number() over (order by source nulls last) as k from n group by source),
w as (select *, 3.0::double * l as cap, case (k - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from s),
level as (select a.k, a.cap / a.weight as ratio, ((select sum(l) from w) - coalesce(sum(b.cap) filter (where b.cap / b.weight < a.cap / a.weight), 0)) / sum(b.weight) filter (where b.cap / b.weight >= a.cap / a.weight) as lam
  from w a cross join w b group by a.k, a.cap, a.weight),
rest as (select arg_min(lam, ratio) as lam from level where lam < ratio),
t as (select source, k, l, case when lam is null or cap <= lam * weight then cap else weight * lam end as target from w cross join rest),
u as (select *, cast(floor(target) as bigint) as words, (cast(floor(target) as bigint) + 63) // 64 as blocks from t),
g as (select cast(sum(blocks) as bigint) as need, count(*) as ns, 3 + cast(ceil(log2(sum(blocks) + count(*) + 2)) as bigint) + 2 * (cast(sum(blocks) as bigint) // {mixing.PHI_DENOMINATOR}) as margin from u),
lim as (select k, blocks, cast((sum(blocks + margin) over (order by k) - blocks - margin) * {mixing.PHI_DENOMINATOR} // (need + margin * ns) as bigint) as low,
  cast(sum(blocks + margin) over (order by k) * {mixing.PHI_DENOMINATOR} // (need + margin * ns) as bigint) as high from u cross join g),
pt as (select unnest(range(need + margin * ns)) as i from g),
slot as (select k, i, row_number() over (partition by k order by i) - 1 as rank from (select i, i % {mixing.PHI_DENOMINATOR} * {mixing.PHI_NUMERATOR} % {mixing.PHI_DENOMINATOR} as p from pt) join lim on p >= low and p < high),
p as (select row_number() over () as r, n.doc_id, n.size, u.k, u.l, u.target, u.words,
  coalesce(cast(sum(n.size) over (partition by n.source order by n.h, n.h2, n.doc_id, n.size rows between unbounded preceding and 1 preceding) as bigint), 0) as start
  from n join u on n.source is not distinct from u.source),
c as (select r, k, c * l + start as low, least(c * l + start + size, words) as high from (select *, unnest(generate_series(0, (words - 1 - start) // l)) as c from p where size > 0 and words > start)),
b as (select r, k, low, high, unnest(generate_series(low // 64, (high - 1) // 64)) as rank from c),
x as (select r, cast(sum(least(high, (b.rank + 1) * 64) - greatest(low, b.rank * 64)) as bigint) as taken, min(i) as first_slot, count(*) as n_slots from b join slot on slot.k = b.k and slot.rank = b.rank group by r)
select doc_id, size, l as source_size, target, coalesce(taken, 0) as taken, first_slot, coalesce(n_slots, 0) as n_slots from p left join x using (r)
""",
}
