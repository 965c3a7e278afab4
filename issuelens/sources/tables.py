"""Driver tables and the derived ``issues`` view.

The test tables carry no issue dumps, so issues are derived from ``documents``
with one SQL body that Spark and DuckDB both run unchanged.  Every decoration
depends only on the text length, so equal texts stay equal.  Repos
``repo0..2`` stand for the *seen* repos, ``repo3..5`` for the *unseen* ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

N_REPOS = 6
SEEN_REPOS = tuple(f"repo{i}" for i in range(3))
UNSEEN_REPOS = tuple(f"repo{i}" for i in range(3, 6))

_NL = "chr(10)"
_TITLE = f"split_part(text, {_NL}, 1)"

# (column, SQL expression over ``documents``); valid in Spark SQL and DuckDB.
ISSUE_COLUMNS: tuple[tuple[str, str], ...] = (
    ("repo", f"concat('repo', cast(cast(substr(source, 4) as int) % {N_REPOS} as string))"),
    ("id", "doc_id"),
    ("title", _TITLE),
    ("body",
     f"concat(substr(text, length({_TITLE}) + 2), "
     f"case when length(text) % 3 = 0 then concat({_NL}, '```', {_NL}, 'let x = 1;', {_NL}, '```', {_NL}) else '' end, "
     f"case when length(text) % 4 = 0 then concat({_NL}, '```', {_NL}, '2024-01-02 03:04:05 ERROR: boom', {_NL}, '```', {_NL}) else '' end, "
     "case when length(text) % 5 < 3 then ' see [the guide](https://docs.example.com/a_b?c=1) or https://www.example.org/x#y , cc @octo about #12 .' else '' end, "
     "case length(text) % 7 when 0 then ' would like a new feature using the current type of convert operation' "
     "when 1 then ' panic error on build of the local core' else '' end)"),
    ("labels",
     f"concat(case when cast(substr(source, 4) as int) % {N_REPOS} < 3 then 'C-' else 'kind/' end, "
     "case doc_id % 8 when 0 then 'bug' when 1 then 'bug' when 2 then 'enhancement' when 3 then 'feature' "
     "when 4 then 'doc' when 5 then 'bug' when 6 then 'discussion' else 'cleanup' end)"),
    ("url", "concat('https://api.example.com/repos/x/issues/', cast(doc_id as string))"),
    ("updated_s", "1704067200 + doc_id * 60"),
)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


# Session setting: deal a scanned table out to this many partitions.  Unset (the
# default) the scan stays as it is; the bench and the tests set it, because their
# files hold one row group each and would be read by a single task.
SPREAD_SETTING = "issuelens.scan.spread"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it."""
    df = spark.read.parquet(table_path(sf_dir, name))
    spread = spark.conf.get(SPREAD_SETTING, None)
    return df.repartition(int(spread)) if spread else df


def issues_from_documents(documents: DataFrame) -> DataFrame:
    """Project documents into the issue shape (narrow: no shuffle)."""
    return documents.selectExpr(*[f"{expr} as {name}" for name, expr in ISSUE_COLUMNS])


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues_from_documents(read_table(spark, sf_dir, "documents"))


def issues_sql() -> str:
    """The same view as a DuckDB query over the ``documents`` view."""
    cols = ",\n  ".join(f"{expr.replace(' as string)', ' as varchar)')} as {name}"
                       for name, expr in ISSUE_COLUMNS)
    return f"select\n  {cols}\nfrom documents"
