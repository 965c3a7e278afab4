"""Catalog queries: duplicates, ids, vocabulary, tokenisers, HTML, hand-made
features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import dedupe, labels, sentences, vocab
from ..sources import tables
from . import common as C
from . import oracle as O
from .catalog import register

W = O.with_ctes
_WL = ", ".join(O.q(w) for w in labels.whitelist())


# --- duplicates (A1, A2, J1, S7) and ids (P1) -------------------------------------

_KEYED_SQL = ("select repo, id, labels, sha256(coalesce(cast(length(body) as varchar), 'null') || ':' || coalesce(body, '') || "
              "coalesce(cast(length(title) as varchar), 'null') || ':' || coalesce(title, '')) as k "
              f"from issues where labels in ({_WL})")
_GROUPS_SQL = ("select repo, k, min(id) as min_id, count(*) as n_rows, min(labels) <> max(labels) as conflicting "
               "from wl group by repo, k having count(*) > 1")
_BAD_SQL = ("select distinct repo, id from (select repo, min_id as id from grp where not conflicting "
            "union all select w.repo, w.id from wl w join grp g on w.repo = g.repo and w.k = g.k where g.conflicting)")
_DEDUPE_CTES = O.base_ctes() + [("wl", _KEYED_SQL), ("grp", _GROUPS_SQL), ("bad", _BAD_SQL)]


def _bad(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.bad_ids(C.issues(spark, sf), labels.whitelist())


@register("duplicate_groups", "A1", W(_DEDUPE_CTES, "select repo, min_id, n_rows, conflicting from grp"))
def duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.duplicate_groups(C.issues(spark, sf), labels.whitelist()).drop("_key")


@register("bad_ids", "A2/T6", W(_DEDUPE_CTES, "select repo, id from bad"))
def bad_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _bad(spark, sf)


# The same duplicates over ids that are counted per repo, so they repeat across repos.
LOCAL_DEDUPE_CTES = ([("issues", f"select * replace (id + 7 * cast(substr(repo, 5) as bigint) as id) from ({tables.issues_sql()})")]
                     + _DEDUPE_CTES[1:])
KEPT_SQL = "from issues i where not exists (select 1 from bad b where b.repo = i.repo and b.id = i.id)"


def local_issues(spark: SparkSession, sf: str) -> DataFrame:
    return C.issues(spark, sf).withColumn("id", F.col("id") + 7 * F.substring("repo", 5, 9).cast("bigint"))


@register("remove_duplicates", "J1", W(LOCAL_DEDUPE_CTES, f"select id, repo {KEPT_SQL}"))
def remove_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    iss = local_issues(spark, sf)
    return dedupe.remove_duplicates(iss, dedupe.bad_ids(iss, labels.whitelist())).select("id", "repo")


@register("bad_ids_file", "S7", W(_DEDUPE_CTES, "select repo, id from bad"))
def bad_ids_file(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.bad_ids_roundtrip(spark, _bad(spark, sf)).select("repo", "id")


@register("assign_ids", "P1", W(O.base_ctes(), """
select repo, id, row_number() over (order by repo, id) - 1 as seq_id from issues"""))
def assign_ids(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.assign_ids(C.issues(spark, sf).select("repo", "id"), ["repo", "id"]).select("repo", "id", "seq_id")


# --- vocabulary (A11, A12, T1-T3, J5, J6, U2, F11) ----------------------------------

def _tok_sql(x: str) -> str:
    return f"unnest({O.tokens(x)})"


@register("token_counts", "A11", W(O.base_ctes(), f"""
select word, count(*) as n from (select {_tok_sql('body')} as word from issues) group by word"""))
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return vocab.token_counts(vocab.exploded_tokens(C.issues(spark, sf), F.col("body")))


_SEEN_TOKENS = ("st", f"select label, {_tok_sql('body')} as word from ds where split = 'seen'")
_COMMON = ("common", "select word, count(*) as n from st group by word order by n desc, word limit 50")
_RARE = ("rare", "select label, word, count(*) as n from st where word not in (select word from common) group by all")
_TOP_CLASS = ("topc", "select label, word, n, cast(rank as integer) as rank from (select label, word, n, "
              "row_number() over (partition by label order by n desc, word) as rank from rare) where rank <= 150")


def _seen_tokens(spark: SparkSession, sf: str) -> DataFrame:
    ds = C.dataset(spark, sf).filter(F.col("split") == "seen")
    return vocab.exploded_tokens(ds, F.col("body"), keep=["label"])


def _seen_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    """``(label, word, n)`` over the seen bodies: the one token aggregate that
    both the common words and the per-class counts are read from (the same
    plan twice, so Spark reuses its exchange)."""
    return vocab.token_counts(_seen_tokens(spark, sf), by=["label"])


def _common_words(spark: SparkSession, sf: str) -> DataFrame:
    per_word = _seen_class_counts(spark, sf).groupBy("word").agg(F.sum("n").alias("n"))
    return vocab.top_words(per_word, 50)


def _rare_counts(spark: SparkSession, sf: str) -> DataFrame:
    return vocab.drop_words(_seen_class_counts(spark, sf), _common_words(spark, sf))


def _top_per_class(spark: SparkSession, sf: str) -> DataFrame:
    return vocab.top_words_per_group(_rare_counts(spark, sf), "label", 150)


@register("top_common_words", "T1", W(C.ctes_dataset() + [_SEEN_TOKENS], _COMMON[1]))
def top_common_words(spark: SparkSession, sf: str) -> DataFrame:
    return _common_words(spark, sf)


@register("drop_common_words", "J5", W(C.ctes_dataset() + [_SEEN_TOKENS, _COMMON], _RARE[1]))
def drop_common_words(spark: SparkSession, sf: str) -> DataFrame:
    return _rare_counts(spark, sf)


@register("top_words_per_class", "T2", W(C.ctes_dataset() + [_SEEN_TOKENS, _COMMON, _RARE], _TOP_CLASS[1]))
def top_words_per_class(spark: SparkSession, sf: str) -> DataFrame:
    return _top_per_class(spark, sf).select("label", "word", "n", "rank")


_INFLUENTIAL = ("infl", "select distinct lower(word) as word from topc")


@register("influential_words", "U2", W(C.ctes_dataset() + [_SEEN_TOKENS, _COMMON, _RARE, _TOP_CLASS], _INFLUENTIAL[1]))
def influential_words(spark: SparkSession, sf: str) -> DataFrame:
    return vocab.influential_words(_top_per_class(spark, sf))


@register("word_count_vector", "F11", W(C.ctes_dataset() + [_SEEN_TOKENS, _COMMON, _RARE, _TOP_CLASS, _INFLUENTIAL], f"""
select id, word, count(*) as n from (select id, {_tok_sql('lower(body)')} as word from ds)
where word in (select word from infl) group by all"""))
def word_count_vector(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = vocab.influential_words(_top_per_class(spark, sf))
    return vocab.word_count_vectors(C.dataset(spark, sf), F.col("body"), vocabulary)


_STOP = ", ".join(O.q(w) for w in vocab.STOPWORDS)


@register("drop_stopwords", "J6", W(O.base_ctes(), f"""
select word, count(*) as n from (select unnest(list_concat({O.tokens('title')}, {O.tokens('body')})) as word from issues)
where word not in ({_STOP}) group by word"""))
def drop_stopwords(spark: SparkSession, sf: str) -> DataFrame:
    iss = C.issues(spark, sf)
    toks = iss.select(F.explode(F.concat(T.tokens("title"), T.tokens("body"))).alias("word"))
    return vocab.token_counts(vocab.drop_words(toks, vocab.stopword_frame(spark)))


_CLASS_SQL = ("cls", "select i.*, case m.label when 0 then 'feature' when 1 then 'bug' when 2 then 'doc' "
              "else case when i.repo = 'repo1' and i.labels = 'C-cleanup' then 'bug' "
              "when i.repo = 'repo2' and i.labels <> 'C-discussion' then 'bug' else 'other' end end as class from issues i left join lmap m on i.repo = m.repo and i.labels = m.raw_label "
              "where i.repo in (select repo from lmap where split = 'seen')")
_CLASS_COUNTS = ("cc", f"select class, word, count(*) as n from (select class, unnest(list_concat({O.tokens('title')}, "
                       f"{O.tokens('body')})) as word from cls) where word not in ({_STOP}) group by all")


def _class_counts(spark: SparkSession, sf: str) -> DataFrame:
    seen_repos = [r for r, s in labels.repo_splits().items() if s == "seen"]
    iss = C.issues(spark, sf).filter(F.col("repo").isin(seen_repos))
    names = labels.profile_class(labels.fixture_label_map(), labels.fixture_profile_rules())
    toks = iss.select(names.alias("class"), F.explode(F.concat(T.tokens("title"), T.tokens("body"))).alias("word"))
    return vocab.token_counts(vocab.drop_words(toks, vocab.stopword_frame(spark)), by=["class"])


@register("class_token_counts", "A12", W(O.base_ctes() + [_CLASS_SQL, _CLASS_COUNTS], "select * from cc"))
def class_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _class_counts(spark, sf)


@register("freq_dist_top80", "T3", W(O.base_ctes() + [_CLASS_SQL, _CLASS_COUNTS], """
select class, word, n, cast(rank as integer) as rank from (select class, word, n, row_number() over (partition by class order by n desc, word) as rank from cc)
where rank <= 80"""))
def freq_dist_top80(spark: SparkSession, sf: str) -> DataFrame:
    return vocab.top_words_per_group(_class_counts(spark, sf), "class", 80).select("class", "word", "n", "rank")


# --- tokenisers, sentences, HTML, hand-made features (F8-F10, F12, F18) ----------------

@register("tokenise", "F10", W(O.base_ctes(), f"""
select id, cast(len({O.tokens('body')}) as integer) as n_words,
  cast(len(list_distinct({O.tokens('body', True)})) as integer) as n_distinct_lower,
  cast(len({O.extract_all('body', P.VECTOR_TOKEN)}) as integer) as n_vector_tokens,
  array_to_string({O.tokens('body')}, ' ') as words from issues"""))
def tokenise(spark: SparkSession, sf: str) -> DataFrame:
    return C.issues(spark, sf).select(
        "id", F.size(T.tokens("body")).alias("n_words"),
        F.size(F.array_distinct(T.tokens("body", lower=True))).alias("n_distinct_lower"),
        F.size(T.vector_tokens("body")).alias("n_vector_tokens"),
        F.array_join(T.tokens("body"), " ").alias("words"))


def _sentences_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {O.rx(P.SENTENCE_END)}), lambda s: length(s) > 0)"


@register("sentence_split", "F18", W(O.base_ctes(), f"""
select id, cast(len({_sentences_sql(O.remove_markdown('body'))}) as integer) as n_sentences,
  array_to_string({_sentences_sql(O.remove_markdown('body'))}, chr(10)) as sentences from issues"""))
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    s = T.sentence_split(T.remove_markdown("body"))
    return C.issues(spark, sf).select("id", F.size(s).alias("n_sentences"),
                                      F.array_join(s, "\n").alias("sentences"))


_LOWER = f"'{sentences.UPPER}', '{sentences.LOWER}'"
_LETTERS = "length(replace(word, '.', ''))"
_PIECES = f"string_split(regexp_replace(translate(body, chr(1), ' '), '{sentences.BOUNDARY}', '\\1' || chr(1), 'g'), chr(1))"
_ABBREVIATIONS = [
    ("tok", f"select unnest(regexp_extract_all(body, '{sentences.WORD}')) as t from issues"),
    ("wc", f"select translate(regexp_replace(t, '\\.+$', ''), {_LOWER}) as word, count(*) as n, "
           "sum(case when t like '%.' and t not like '%..' then 1 else 0 end) as k from tok group by 1"),
    ("sh", "select sum(k) / sum(n) as p0 from wc"),
    ("scored", f"""select word, n, cast(k as bigint) as k,
  2 * (k * (ln({sentences.ALWAYS}) - ln(p0)) + (n - k) * (ln({1 - sentences.ALWAYS}) - ln(1 - p0)))
  * exp(-{_LETTERS}) * (length(word) - {_LETTERS} + 1) * pow({_LETTERS}, cast(k - n as double)) as score
from wc, sh where k > 0"""),
    ("abbr", f"select * from scored where score >= {sentences.LEAST_SCORE}"),
]
_TRAINED = _ABBREVIATIONS + [
    ("cut", f"select id, list_filter({_PIECES}, lambda p: length(p) > 0) as ps from issues"),
    ("pc", "select id, unnest(ps) as p, unnest(range(len(ps))) as i from cut"),
    ("mk", f"select id, i, p || case when translate(regexp_extract(p, '{sentences.LAST_WORD}', 1), {_LOWER}) in (select word from abbr) "
           "then '' else chr(1) end as p from pc"),
    ("tx", "select id, list_filter(list_transform(string_split(string_agg(p, '' order by i), chr(1)), "
           "lambda s: regexp_replace(s, '^[ \\n]+|[ \\n]+$', '', 'g')), lambda s: length(s) > 0) as ss from mk group by id"),
]


@register("abbreviations", "F18", W(O.base_ctes() + _ABBREVIATIONS, "select word, n, k, round(score, 6) as score from abbr"))
def abbreviations(spark: SparkSession, sf: str) -> DataFrame:
    found = sentences.abbreviations(C.issues(spark, sf), F.col("body"))
    return found.withColumn("score", F.round("score", 6))


@register("trained_sentences", "F18", W(O.base_ctes() + _TRAINED, """
select i.id, cast(coalesce(len(ss), 0) as integer) as n_sentences, coalesce(array_to_string(ss, chr(10)), '') as sentences
from issues i left join tx on i.id = tx.id"""))
def trained_sentences(spark: SparkSession, sf: str) -> DataFrame:
    iss = C.issues(spark, sf)
    out = sentences.sentences(iss, F.col("body"), sentences.abbreviations(iss, F.col("body")))
    return out.select("id", F.size("sentences").alias("n_sentences"), F.array_join("sentences", "\n").alias("sentences"))


@register("extract_links", "F8", f"""
select page_id, cast(len({O.extract_all('html', P.HTML_LINK, 1)}) as integer) as n_links,
  array_to_string({O.extract_all('html', P.HTML_LINK, 1)}, chr(10)) as links from pages""")
def extract_links(spark: SparkSession, sf: str) -> DataFrame:
    links = T.extract_links("html")
    return tables.read_table(spark, sf, "pages").select(
        "page_id", F.size(links).alias("n_links"), F.array_join(links, "\n").alias("links"))


_RENDERED = f"regexp_replace({O.replace_all('body', P.FENCE, '')}, {O.rx(P.CODE_SPAN)}, '', 'g')"
_ISSUE_LINKS = (f"list_transform(list_filter(regexp_extract_all({_RENDERED}, {O.rx(P.MARKDOWN_LINK)}), lambda m: not starts_with(m, '!')), "
                "lambda m: " + " || ".join(f"regexp_extract(m, {O.rx(P.MARKDOWN_LINK)}, {i})" for i in (1, 2, 3)) + ")")


_FOLD = f"'{T.ASCII_UPPER}', '{T.ASCII_LOWER}'"
_LINK_PARTS = [f"regexp_extract(m, {O.rx(P.ANY_LINK)}, {i})" for i in range(1, 6)]
_LINK_CTES = [
    ("ren", f"select id, {_RENDERED} as t from issues"),
    ("defs", f"select id, regexp_extract_all(translate(t, {_FOLD}), {O.rx(P.LINK_DEFINITION)}, 1) as ls, regexp_extract_all(t, {O.rx(P.LINK_DEFINITION)}, 2) as us, "
             f"regexp_extract_all(regexp_replace(regexp_replace(t, {O.rx(P.LINK_DEFINITION)}, '', 'g'), {O.rx(P.MARKDOWN_IMAGE)}, '', 'g'), {O.rx(P.ANY_LINK)}) as ms from ren"),
    ("each", "select id, ls, us, unnest(ms) as m, unnest(range(len(ms))) as i from defs"),
    ("got", f"select id, i, {_LINK_PARTS[1]} || {_LINK_PARTS[2]} || {_LINK_PARTS[4]} as given, ls, us, "
            f"translate(case when {_LINK_PARTS[3]} <> '' then {_LINK_PARTS[3]} else {_LINK_PARTS[0]} end, {_FOLD}) as label from each"),
    ("tgt", "select id, i, case when given <> '' then given else coalesce(us[list_position(ls, label)], '') end as target from got"),
    ("per", "select id, count(*) as n, string_agg(target, chr(10) order by i) as links from tgt where target <> '' group by id"),
]


@register("extract_rendered_links", "F8", W(O.base_ctes() + _LINK_CTES, """
select i.id, cast(coalesce(n, 0) as integer) as n_links, coalesce(links, '') as links from issues i left join per on i.id = per.id"""))
def extract_rendered_links(spark: SparkSession, sf: str) -> DataFrame:
    links = T.extract_rendered_links("body")
    return C.issues(spark, sf).select("id", F.size(links).alias("n_links"), F.array_join(links, "\n").alias("links"))


@register("extract_issue_links", "F8", W(O.base_ctes(), f"""
select id, cast(len({_ISSUE_LINKS}) as integer) as n_links, array_to_string({_ISSUE_LINKS}, chr(10)) as links from issues"""))
def extract_issue_links(spark: SparkSession, sf: str) -> DataFrame:
    """The reference renders an issue's markdown and reads the links; here they are read before rendering."""
    links = T.extract_markdown_links("body")
    return C.issues(spark, sf).select("id", F.size(links).alias("n_links"), F.array_join(links, "\n").alias("links"))


@register("html_to_text", "F9", f"""
select page_id, {O.replace_all(O.replace_all('html', P.HTML_IMG, P.IMAGE_TOKEN), P.HTML_TAG, '')} as text from pages""")
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_table(spark, sf, "pages").select("page_id", T.html_to_text("html").alias("text"))


def handcrafted_values_sql() -> list[str]:
    text = O.replace_all("body", P.FENCE, "")
    words = O.tokens(text)
    vals = [
        "length(title)", f"length({text})", f"len({O.code_blocks('body')})",
        f"len(list_distinct({words}))",
        f"len(list_filter({words}, lambda w: regexp_matches(w, {O.rx(P.UPPER_INITIAL)})))",
        O.count(text, P.USERNAME), O.count(text, P.ISSUE_REFERENCE), O.count(text, P.LINK),
        O.count(text, P.IMAGE), O.count(text, P.CODE_MARK), O.count(text, P.ASTERISK),
        O.count(text, P.UNDERSCORE), O.count(text, P.HASH)]
    return vals


def _handcrafted_sql() -> str:
    vals = handcrafted_values_sql()
    cols = ", ".join(f"cast({v} as integer) as {n}" for v, n in zip(vals, T.HANDCRAFTED_NAMES))
    return W(C.ctes_dataset(), f"select id, label, {cols} from ds")


def handcrafted_frame(spark: SparkSession, sf: str) -> DataFrame:
    ds = C.dataset(spark, sf).withColumn("_s", T.split_code_text("body"))
    feats = T.handcrafted_features("title", F.col("_s.text"), F.col("_s.codeblocks"))
    return ds.select("id", "label", feats.alias("features"))


@register("handcrafted_features", "F12", _handcrafted_sql())
def handcrafted_features(spark: SparkSession, sf: str) -> DataFrame:
    f = handcrafted_frame(spark, sf)
    return f.select("id", "label", *[F.col("features")[i].alias(n) for i, n in enumerate(T.HANDCRAFTED_NAMES)])
