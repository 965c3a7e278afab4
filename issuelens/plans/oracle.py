"""SQL (DuckDB dialect) twins of the Spark operators, used as the oracle.

Each builder returns a SQL fragment over named relations; ``with_ctes``
assembles a full query.  Regexes come from ``functions.patterns`` through
``re2`` so both engines evaluate the same expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..functions import patterns as P
from ..operators import keyword, labels
from ..sources.tables import issues_sql

q = P.sql_str


def with_ctes(ctes: Sequence[tuple[str, str]], body: str) -> str:
    parts = ",\n".join(f"{name} as (\n{sql}\n)" for name, sql in ctes)
    return f"with {parts}\n{body}"


def rx(pattern: str) -> str:
    return q(P.re2(pattern))


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {rx(pattern)}))"


def extract_all(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {rx(pattern)}, {group})"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {rx(pattern)})"


def replace_all(x: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({x}, {rx(pattern)}, {q(repl)}, 'g')"


# --- base relations -----------------------------------------------------------------

def label_map_values(mapping=None) -> str:
    rows = ", ".join(f"({q(s)}, {q(r)}, {q(raw)}, {lab})"
                     for s, r, raw, lab in labels.label_map_rows(mapping or labels.fixture_label_map()))
    return f"select * from (values {rows}) t(split, repo, raw_label, label)"


def base_ctes() -> list[tuple[str, str]]:
    return [("issues", issues_sql()), ("lmap", label_map_values())]


def dataset_cte(src: str = "issues") -> str:
    """P2 + P3 + split tag (inner join = left join then drop -1)."""
    return (f"select i.*, cast(m.label as integer) as label, m.split from {src} i "
            f"join lmap m on i.repo = m.repo and i.labels = m.raw_label")


def flagged_cte(src: str = "ds", share: float = 0.8, seed: int = 1, groups=("seen",)) -> str:
    """T4 + T5: first ceil(share*n) of the md5 order per split are training."""
    in_groups = ", ".join(q(g) for g in groups)
    return (f"select *, (split in ({in_groups}) and row_number() over (partition by split order by "
            f"md5(concat_ws('-', cast(id as varchar), {q(str(seed))}))) <= "
            f"ceil({share} * count(*) over (partition by split))) as is_train from {src}")


def concat_features(columns=("title", "body"), trailing: bool = True) -> str:
    parts = [f"coalesce({c}, '')" for c in columns]
    out = " || ' ' || ".join(parts)
    return f"({out} || ' ')" if trailing else f"({out})"


def keyword_pred(x: str, as_written: bool = False) -> str:
    counts = [count(x, p) for p in keyword.keyword_patterns(as_written)]
    codes = (0, 1, 2) if as_written else tuple(labels.CLASSES[c] for c in keyword.KEYWORD_CLASSES)
    top = f"greatest({', '.join(counts)})"
    whens = " ".join(f"when {c} = {top} then {code}" for c, code in zip(counts, codes))
    return f"cast(case when {top} = 0 then -1 {whens} end as integer)"


# --- metrics -------------------------------------------------------------------------

def metrics_body(src: str, by: Sequence[str] = (), truth: str = "label", pred: str = "pred",
                 digits: int = 6) -> tuple[list[tuple[str, str]], str]:
    """CTEs + final select computing the evaluate.classification_metrics columns."""
    b = "".join(f"{c}, " for c in by)
    cells = f"select {b}{truth} as y, {pred} as p, count(*) as n from {src} group by all"
    side = (f"select {b}y as c, n as support, case when y = p then n else 0 end as tp, 0 as npred, "
            f"n as n_all, case when p <> -1 then n else 0 end as n_lab, "
            f"case when p <> -1 and p = y then n else 0 end as n_cor, "
            f"case when p = 2 then n else 0 end as n_doc from m_cells "
            f"union all select {b}p as c, 0, 0, n, 0, 0, 0, 0 from m_cells")
    per = (f"select {b}c, sum(support) as support, sum(tp) as tp, sum(npred) as npred, sum(n_all) as n_all, "
           f"sum(n_lab) as n_lab, sum(n_cor) as n_cor, sum(n_doc) as n_doc from m_side group by all")
    prf = ("select *, case when npred > 0 then tp / npred else 0.0 end as prec, "
           "case when support > 0 then tp / support else 0.0 end as rec from m_per")
    f1 = ("select *, case when prec + rec > 0 then 2 * prec * rec / (prec + rec) else 0.0 end as f "
          "from m_prf")
    sel = (f"select {b}cast(sum(n_all) as bigint) as n_rows, cast(sum(n_lab) as bigint) as n_labelled, "
           f"cast(sum(n_cor) as bigint) as n_correct, cast(sum(n_doc) as bigint) as n_pred_doc, "
           f"round(sum(n_cor) / nullif(sum(n_lab), 0), {digits}) as accuracy, "
           f"round(sum(support * prec) / nullif(sum(support), 0), {digits}) as precision, "
           f"round(sum(support * rec) / nullif(sum(support), 0), {digits}) as recall, "
           f"round(sum(support * f) / nullif(sum(support), 0), {digits}) as fscore "
           f"from m_f1" + (f" group by {', '.join(by)}" if by else ""))
    return ([("m_cells", cells), ("m_side", side), ("m_per", per), ("m_prf", prf), ("m_f1", f1)], sel)


# --- text expressions (twins of functions.text) -------------------------------------

def has_log(x: str, as_written: bool = True) -> str:
    return matches(x, P.log_pattern(as_written))


def code_blocks(x: str) -> str:
    return extract_all(x, P.FENCE)


def has_code_block(x: str, as_written: bool = True) -> str:
    log = rx(P.log_pattern(as_written))
    return f"(len(list_filter({code_blocks(x)}, lambda b: not regexp_matches(b, {log}))) > 0)"


def _remove_blocks(x: str, keep_if_log: bool, as_written: bool) -> str:
    log = rx(P.log_pattern(as_written))
    test = f"not regexp_matches(b, {log})" if keep_if_log else f"regexp_matches(b, {log})"
    return (f"list_reduce(list_filter({code_blocks(x)}, lambda b: {test}), "
            f"lambda a, b: replace(a, b, ''), {x})")


def remove_code_block(x: str, as_written: bool = True) -> str:
    return _remove_blocks(x, True, as_written)


def remove_log(x: str, as_written: bool = True) -> str:
    out = _remove_blocks(x, False, as_written)
    if not as_written:
        out = replace_all(out, P.log_line_pattern(False), "")
    return out


def remove_url(x: str) -> str:
    inner = f"regexp_replace({x}, {rx(P.MARKDOWN_EMPHASIS_OR_LINK)}, '\\1', 'g')"
    return replace_all(inner, P.URL, "")


def remove_markdown(x: str) -> str:
    return replace_all(x, P.MARKDOWN, " ")


CLEANERS = {"remove_code_block": remove_code_block, "remove_log": remove_log,
            "remove_url": remove_url, "remove_markdown": remove_markdown}


def clean(x: str, steps=("remove_url", "remove_log")) -> str:
    for s in steps:
        x = CLEANERS[s](x)
    return x


def has_url(x: str) -> str:
    return matches(x, P.URL)


def tokens(x: str, lower: bool = False) -> str:
    return extract_all(f"lower({x})" if lower else x, P.WORD)


def issue_number(url: str) -> str:
    return f"cast(split_part({url}, '/', -1) as bigint)"
