"""The corpus operators as queries over whole tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, licenses, line_dedup, minhash, mixing, packing, pii, quality, quality_model, spelling, tokens, url_filter, vector_links
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return put


@query("op9_url_filter")
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

MIX_SQL = r"""
with d as (
  select doc_id, source, coalesce(text, '') as text,
    cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) as bigint) as size,
    translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') as bare
  from documents),
k as (
  select doc_id, source, size,
    (cast('0x' || substr(md5('7:' || coalesce(cast(doc_id as varchar), 'null') || ':' || md5(text)), 1, 13) as bigint) + 0.5::double)
      / 4503599627370496.0::double as digest,
    greatest(0.05::double, (1.0::double - 2.0::double * (length(bare) - length(translate(bare, '#*$%&|<>', '')))
      / greatest(length(bare), 1)) * least(1.0::double, size / 50.0::double)) as quality
  from d),
r as (select doc_id, source, size, digest, -ln(digest) / quality as key from k),
per as (
  select source, cast(sum(size) as bigint) as source_size,
    [3.0::double, 1.0::double, 2.0::double][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] as weight
  from r group by source),
w as (select *, 2.0::double * source_size as cap from per),
lev as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over before, 0.0::double))
     / (sum(weight) over () - coalesce(sum(weight) over before, 0.0::double)) as level
  from w window before as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
one as (select min_by(level, cap / weight) as level from lev where cap / weight > level),
t as (
  select lev.source, source_size, case when one.level is null then cap else least(cap, one.level * weight) end as target
  from lev, one),
e as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as epochs from t),
run as (
  select r.*, e.source_size, e.target, e.epochs,
    sum(size) over (partition by r.source order by key, digest) as upto
  from r join e on r.source is not distinct from e.source),
pick as (
  select *, bool_or(size > 0 and upto - size / 2.0::double <= target - epochs * source_size)
     over (partition by source order by key, digest rows between current row and unbounded following) as inside
  from run)
select doc_id, size, source_size, target,
  cast((epochs + case when size > 0 and inside then 1 else 0 end) * size as bigint) as taken,
  cast(epochs + case when size > 0 and inside then 1 else 0 end as bigint) as copies
from pick
"""


@query("op4_mix_sources", MIX_SQL)
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sizes(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


_RATIO_SQL = {
    "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "upper_ratio": "n_up / greatest(word_chars, 1)",
    "mark_ratio": "n_mark / greatest(word_chars, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
}


def _value_sql(bucket: str) -> str:
    return (f"case when {bucket} = 0 then 0.0::double else {quality.TINY}::double * pow({quality.GAMMA!r}::double, {bucket}) "
            f"* {2 / (1 + quality.GAMMA)!r}::double end")


def _decile_sql(keys: str) -> str:
    """Deciles 1, 5 and 9 of the sketches merged by ``keys``."""
    by = f"{keys}, " if keys else ""
    run = (f"select {by}ratio, bucket, n, sum(n) over (partition by {by}ratio order by bucket) as upto, "
           f"sum(n) over (partition by {by}ratio) as total from (select {by}ratio, bucket, sum(n) as n from sk group by all)")
    deciles = ", ".join(f"min(case when upto >= {f}::double * total then bucket end) as b_{name}" for name, f in (("lo", 0.1), ("mid", 0.5), ("hi", 0.9)))
    values = ", ".join(f"{_value_sql('b_' + n)} as {n}" for n in ("lo", "mid", "hi"))
    return f"select *, {values} from (select {by}ratio, max(total)::double as total, {deciles} from ({run}) group by all)"


_P = f"{quality.PRIOR_ROWS}.0::double"
_PICK = " ".join(f"when ratio = '{k}' then {v[0]}::double" for k, v in quality.RATIOS.items())
_BAD = " or ".join(f"(r.ratio = '{k}' and ({' or '.join(x for x, on in (('r.v > f.high', v[1]), ('r.v < f.low', v[2])) if on)}))"
                   for k, v in quality.RATIOS.items())
QUALITY_SQL = rf"""
with d as (
  select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w,
    translate(coalesce(text, ''), {_SPACES}, '') as bare,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(translate(x, {_SPACES}, '')) > 0) as lines
  from documents),
wd as (select rid, unnest(w) as word, generate_subscripts(w, 1) as pos from d),
wi as (select rid, pos, lead(word, 4) over p as fifth,
    word || chr(10) || lead(word, 1) over p || chr(10) || lead(word, 2) over p || chr(10) || lead(word, 3) over p || chr(10) || lead(word, 4) over p as win
  from wd window p as (partition by rid order by pos)),
rep as (select rid, pos from (select rid, pos, count(*) over (partition by rid, win) as c from wi where fifth is not null) where c > 1),
cov as (select rid, count(distinct pos + k) as n from rep, range(5) g(k) group by rid),
c as (
  select d.rid, doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(length(bare) as bigint) as word_chars,
    cast(length(bare) - length(translate(bare, '{quality.SYMBOLS}', '')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(cov.n, 0) as bigint) as n_repeat_words,
    len(lines) as n_lines, length(bare) - length(translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as n_up,
    length(bare) - length(translate(bare, '!?', '')) as n_mark
  from d left join cov on d.rid = cov.rid),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from c),
r as ({" union all ".join(f"select rid, lang, source, base_failed, '{k}' as ratio, ({v})::double as v from b" for k, v in _RATIO_SQL.items())}),
sk as (
  select lang, source, ratio, case when v <= {quality.TINY} then 0
    else greatest(0, cast(ceil(ln(v / {quality.TINY}::double) / {quality._ln(quality.GAMMA)!r}::double) as integer)) end as bucket, count(*) as n
  from r where not base_failed group by all),
own as ({_decile_sql("lang, source")}),
bylang as ({_decile_sql("lang")}),
byall as ({_decile_sql("")}),
u as (
  select o.lang, o.source, o.ratio, {", ".join(f"(o.total * o.{n} + {_P} * ((l.total * l.{n} + {_P} * a.{n}) / (l.total + {_P}))) / (o.total + {_P}) as {n}" for n in ("lo", "mid", "hi"))}
  from own o left join bylang l on o.lang is not distinct from l.lang and o.ratio = l.ratio left join byall a on o.ratio = a.ratio),
f as (
  select lang, source, ratio, mid + {quality.FENCE}::double * greatest(mid - lo, case {_PICK} end) as high,
    mid - {quality.FENCE}::double * greatest(hi - mid, case {_PICK} end) as low from u),
bad as (
  select distinct r.rid from r join f on r.lang is not distinct from f.lang and r.source is not distinct from f.source and r.ratio = f.ratio
  where {_BAD})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and rid not in (select rid from bad) as kept
from b
"""


@query("op2_quality_rules", QUALITY_SQL)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept")


@query("op5_pack_sequences")
def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


@query("op10_license_scan")
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    joined = lambda *arrays: F.array_join(F.array_sort(F.array_distinct(F.concat(*arrays))), ",")
    base, own = F.transform("places", lambda p: p["label"]), F.transform("detections", lambda d: d["label"])
    weights = F.transform("detections", lambda d: d["weight"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["start"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(base, own).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(weights), F.lit(0.0))).alias("score"))


@query("op3_personal_data")
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *map(of, pii.KINDS), F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


NEAR_SQL = r"""
with recursive d as (
  select row_number() over () as rid, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
s as (
  select rid, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], chr(10)))) as win
  from d where len(w) > 0),
b as (select rid, win, count(*) as c from s group by all),
t as (select rid, sum(c) as total from b group by rid),
p as (
  select x.rid as a, y.rid as b, sum(least(x.c, y.c)) as n_both
  from b x join b y on x.win = y.win and x.rid <> y.rid group by all),
e as (select a, b from p join t x on a = x.rid join t y on b = y.rid where n_both >= 0.8 * (x.total + y.total - n_both)),
reach as (select rid as a, rid as b from t union select r.a, e.b from reach r join e on r.b = e.a),
k as (select r.a as rid, min(d.doc_id) as class_id, count(*) as class_size from reach r join d on r.b = d.rid group by r.a)
select doc_id, coalesce(class_id, doc_id) as class_id, cast(coalesce(class_size, 1) as bigint) as class_size,
  doc_id is not distinct from coalesce(class_id, doc_id) as kept
from d left join k on d.rid = k.rid
"""


@query("op6_near_duplicates", NEAR_SQL)
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


LINKS_SQL = """
with recursive v as (
  select row_number() over () as rid, vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
    and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
p as (
  select a.rid as a, b.rid as b from v a join v b on a.rid <> b.rid and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.9),
n as (select a as rid, count(*) as n from p group by a),
reach as (select rid as a, rid as b from v union select r.a, p.b from reach r join p on r.b = p.a),
k as (select r.a as rid, min(v.vec_id) as least from reach r join v on r.b = v.rid group by r.a)
select v.vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, k.least as component_id, v.vec_id is not distinct from k.least as kept
from v left join n on v.rid = n.rid join k on v.rid = k.rid
union all
select vec_id, 0, vec_id, true from embeddings
where not coalesce(embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
    and list_bool_or(list_transform(embedding, lambda x: x <> 0)), false)
"""


@query("op1_vector_links", LINKS_SQL)
def op1_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.link_vectors(table(spark, sf_dir, "embeddings"))


LINES_SQL = rf"""
with recursive d as (
  select doc_id, coalesce(text, '') as t, string_split(coalesce(text, ''), chr(10)) as parts from documents),
l as (
  select * from (select doc_id, t, unnest(parts) as line, generate_subscripts(parts, 1) - 1 as pos from d)
  where length(translate(line, {_SPACES}, '')) > 0),
u as (select line, row_number() over (order by line) as k, min(struct_pack(n := doc_id, t := t, p := pos)) as first from l group by line),
g as (
  select distinct k, unnest(case when length(line) < {line_dedup.SHINGLE} then [line] else
    list_transform(range(1, length(line) - {line_dedup.SHINGLE - 2}), lambda i: substring(line, i, {line_dedup.SHINGLE})) end) as gram from u),
z as (select k, count(*) as n from g group by k),
p as (select x.k as a, y.k as b, count(*) as n_both from g x join g y on x.gram = y.gram and x.k <> y.k group by all),
e as (select a, b from p join z x on a = x.k join z y on b = y.k where n_both >= {line_dedup.THRESHOLD} * (x.n + y.n - n_both)),
reach as (select k as a, k as b from u union select r.a, e.b from reach r join e on r.b = e.a),
best as (select distinct min(u.first) as first from (select a, b from reach) r join u on r.b = u.k group by r.a),
gone as (
  select doc_id, t, pos from l where not exists (
    select 1 from best where best.first.n is not distinct from l.doc_id and best.first.t = l.t and best.first.p = l.pos))
select d.doc_id, cast((select count(*) from (select unnest(d.parts) as x) where length(translate(x, {_SPACES}, '')) > 0) as bigint) as n_lines,
  cast(len(coalesce(k.dropped, [])) as bigint) as n_dropped, array_to_string(coalesce(k.dropped, []), ',') as dropped
from d left join (select doc_id, t, list(distinct pos order by pos) as dropped from gone group by all) k
  on d.doc_id is not distinct from k.doc_id and d.t = k.t
"""


@query("op7_line_dedup", LINES_SQL)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = line_dedup.dropped_lines(table(spark, sf_dir, "documents"))
    return gone.withColumn("dropped", F.array_join(F.array_sort("dropped"), ","))


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(table(spark, sf_dir, "conversations"))


# The crc is taken byte by byte through a table that the first expression derives from the polynomial.
VARIANTS_SQL = r"""
with recursive tab as (
  select list(c order by i) as t from (
    select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from range(256) g(i))),
run as (
  select doc_id, run, count(*) as n from (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run
    from documents) where length(run) >= 5 group by all),
byte as (
  select doc_id, run, n, flatten(list_transform(string_split(coalesce(cast(doc_id as varchar), 'null') || ':' || run, ''),
    lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [(192 | (unicode(x) >> 6))::bigint, (128 | (unicode(x) & 63))::bigint] end)) as b
  from run),
hash as (
  select run, n, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295::bigint) as h
  from byte, tab),
w as (
  select word, cast(sum(n) as bigint) as n from (
    select n, case when h % 97 <> 0 then run else substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) end as word from hash)
  where length(word) >= 5 group by word having sum(n) >= 3),
cut as (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from w, lateral (select unnest(range(1, length(word) + 1)) as i)),
p as (
  select distinct cut.word as a, w.word as b from cut join w on cut.rest = w.word
  union select distinct x.word, y.word from cut x join cut y on x.i = y.i and x.rest = y.rest and x.word <> y.word),
near as (select a, b from p union select b, a from p),
best as (
  select near.a as word, count(*) as n_near, max(w.n) as form_n,
    arg_min(near.b, struct_pack(m := -w.n, b := near.b)) as form from near join w on near.b = w.word group by near.a),
f as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when form_n >= 2 * w.n then form end as form, case when form_n >= 2 * w.n then form_n end as form_n
  from w left join best on w.word = best.word),
walk as (select word, word as here, 0 as k from f union all select walk.word, f.form, k + 1 from walk join f on walk.here = f.word where f.form is not null)
select f.word, form, root, n, cast(n_near as bigint) as n_near, cast(form_n as bigint) as form_n
from f join (select word, arg_max(here, k) as root from walk group by word) r on f.word = r.word
"""


@query("op12_spelling_variants", VARIANTS_SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query("op11_quality_model")
def op11_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
