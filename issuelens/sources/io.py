"""Issue dumps, scrape specs, persisted tables and sinks.

Readers always pass an explicit schema (no inference pass over the data) and
writers always partition by the columns later reads filter on (``repo``,
``split``), so a later filter prunes whole folders.  Every path is a new folder
under the shared ``spark.checkpoint.dir`` (see ``session.scratch_path``), never
a machine-local temp folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..session import scratch_path


# Issue dump records (id is present after id assignment).
DUMP_SCHEMA = "title STRING, body STRING, labels STRING, id BIGINT"
# Raw issue records as the public issue API returns them (fields used here).
RAW_SCHEMA = ("id BIGINT, title STRING, body STRING, url STRING, "
              "pull_request STRUCT<url: STRING>, labels ARRAY<STRUCT<name: STRING>>")
SPEC_SCHEMA = "repo STRING, desired_labels ARRAY<STRING>, _corrupt_record STRING"

# File name of a reference-style dump (``rust.json``, ``rust_removed_dups.json``)
# or a partition folder written by ``write_issues_json`` (``repo=rust/``).
REPO_FROM_FILE = r"([^/]+?)(?:_removed_dups|_text_code_split|_links_extracted)?\.json$"
REPO_FROM_FOLDER = r"/repo=([^/]+)/"


def repo_from_path(pattern: str = REPO_FROM_FOLDER) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def scan_issues(spark: SparkSession, paths: str | Sequence[str], schema: str | StructType = DUMP_SCHEMA,
                repo_pattern: str = REPO_FROM_FOLDER, json_array: bool = False, mode: str = "FAILFAST") -> DataFrame:
    """Read issue dumps; the repo name comes from each file's path.

    ``json_array=True`` reads files that hold one JSON array of records (the
    reference's dump format; each file is then one split, so keep files per
    repo moderate); the default reads JSON Lines, which splits freely.
    Partition discovery is off so the repo comes only from ``repo_pattern``.
    A record that is not valid JSON fails the read: a null row in its place
    would lose an issue, or a whole array file, without a trace.  ``mode``
    ("PERMISSIVE", "DROPMALFORMED") opts out of that.
    """
    reader = (spark.read.schema(schema).option("multiLine", json_array)
              .option("recursiveFileLookup", True).option("mode", mode))
    df = reader.json(list(paths) if not isinstance(paths, str) else paths)
    return df.withColumn("repo", repo_from_path(repo_pattern))


def scan_array_dumps(spark: SparkSession, paths: str | Sequence[str], schema: str = DUMP_SCHEMA,
                     repo_pattern: str = REPO_FROM_FILE, first_key: str = "title", between: str = ",") -> DataFrame:
    """Read files that hold one JSON array of flat records each, a file by many tasks.

    The text source cuts a file into byte ranges at ``},{"first_key"``, the place between two
    records whose first field is ``first_key`` (``between`` is what the writer puts there: ``,`` or
    ``, ``).  It cannot stand inside a string: a quote there is escaped, and one that ends a string
    is not followed by a name.  Records must be flat, since a list of objects could hold it.
    A file written in another way (indented, other field order) is read whole, by one task.
    A file that is not one whole array fails the read: a first pass over the pieces, without
    parsing, sees that each file opens and closes its array once (a file cut short could
    otherwise end like a piece), and a record that is not valid JSON raises when it is read.
    """
    fields = StructType.fromDDL(schema)
    if any(isinstance(f.dataType, (ArrayType, MapType, StructType)) for f in fields):
        raise ValueError("records with lists or objects inside are read by scan_issues(json_array=True)")
    start = '{"' + first_key + '"'
    pieces = (spark.read.option("lineSep", "}" + between + start).option("recursiveFileLookup", True)
              .text(list(paths) if not isinstance(paths, str) else paths))
    value = F.regexp_replace("value", r"^\s+|\s+$", "")
    opens, closes = F.col("_v").startswith("["), F.col("_v").endswith("]")
    ends = pieces.select(value.alias("_v"), F.col("_metadata.file_path").alias("file")).filter("_v <> ''").groupBy("file")
    broken = ends.agg(F.count_if(opens).alias("opened"), F.count_if(closes).alias("closed")).filter("opened <> 1 or closed <> 1")
    names = [r["file"] for r in broken.select("file").limit(5).collect()]
    if names:
        raise ValueError(f"malformed dump, not one whole JSON array: {names}")
    # Every piece becomes an array of its own.
    text = F.concat(F.when(opens, F.lit("")).otherwise(F.lit("[" + start)), F.col("_v"),
                    F.when(closes, F.lit("")).otherwise(F.lit("}]")))
    records = pieces.select(value.alias("_v"), repo_from_path(repo_pattern).alias("repo"))
    records = records.filter("_v <> ''").select("repo", F.from_json(text, ArrayType(fields), {"mode": "FAILFAST"}).alias("_all"))
    return records.select("repo", F.explode("_all").alias("_x")).select("_x.*", "repo")


def write_array_dumps(df: DataFrame, path: str, rows: int = 1000) -> str:
    """JSON array files of about ``rows`` records (by ranges of ``id``), in one folder per repo."""
    record = F.struct(*[F.col(c) for c in df.columns if c != "repo"])
    pages = df.groupBy("repo", F.floor(F.col("id") / rows).alias("_page")).agg(
        F.to_json(F.collect_list(record), {"ignoreNullFields": "false"}).alias("value"))
    pages.select("repo", "value").write.option("maxRecordsPerFile", 1).partitionBy("repo").text(path)
    return path


def union_repos(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name (columns missing in one input are null)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_issues_json(df: DataFrame, path: str) -> str:
    """JSON Lines, one folder per repo (``repo=<name>/``)."""
    df.write.mode("overwrite").partitionBy("repo").json(path)
    return path


def read_scrape_specs(spark: SparkSession, path: str) -> DataFrame:
    """S3: one row per (repo, wanted label); an empty list means no label
    filter and gives one row with a null label.  A malformed record, or one
    without a repo, fails the read: without its spec every issue of that repo
    would silently disappear from ``normalise_dump``."""
    specs = (spark.read.schema(SPEC_SCHEMA).option("mode", "PERMISSIVE")
             .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    bad = F.col("_corrupt_record").isNotNull() | F.col("repo").isNull()
    message = F.concat(F.lit("malformed scrape spec: "), F.coalesce("_corrupt_record", F.lit("no repo")))
    checked = specs.withColumn("repo", F.when(bad, F.raise_error(message).cast("string")).otherwise(F.col("repo")))
    return checked.select("repo", F.explode_outer("desired_labels").alias("desired_label"))


def normalise_dump(raw: DataFrame, specs: DataFrame) -> DataFrame:
    """Drop pull requests; per label that the repo's spec asks for, every
    issue that carries it, with that label.  A spec without a filter asks once
    for all issues: each comes out once, with a null label, whether or not it
    carries any.  A label named twice on an issue counts once.
    """
    issues = raw.filter(F.col("pull_request").isNull())
    names = F.array_distinct(F.transform("labels", lambda l: l["name"]))
    rows = issues.join(specs.select("repo", "desired_label"), "repo")
    wanted = F.col("desired_label").isNull() | F.array_contains(names, F.col("desired_label"))
    return rows.filter(wanted).select("repo", "id", "title", "body", F.col("desired_label").alias("labels"))


def write_dataset(df: DataFrame, path: str, partition_cols: Sequence[str] = ("split", "repo")) -> str:
    """Parquet partitioned by split and repo (dataset and feature tables)."""
    df.write.mode("overwrite").partitionBy(*partition_cols).parquet(path)
    return path


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def metrics_long(metrics: DataFrame, keys: Sequence[str], metric_cols: Sequence[str]) -> DataFrame:
    """Wide metric rows to ``(keys..., metric, value)``."""
    m = metrics.select(*keys, *[F.col(c).cast("double").alias(c) for c in metric_cols])
    return m.unpivot(list(keys), list(metric_cols), "metric", "value")


def write_metrics_report(report: DataFrame, path: str) -> str:
    """S8 writer: overwrite = the clean slate of a new report."""
    report.write.mode("overwrite").parquet(path)
    return path


SINK_SCHEMA = "issue_num BIGINT, label STRING, repo STRING, bucket INT"
SINK_BUCKET = 4096    # issue numbers per folder: recent issues have high numbers and share few folders
MOST_FOLDERS = 2000   # folders a batch may name in its filter on the sink


def read_sink(spark: SparkSession, path: str) -> DataFrame | None:
    """The label sink ``(repo, issue_num, label)``, or None before its first
    write.  Only a missing path counts as that; any other problem raises."""
    try:
        return spark.read.schema(SINK_SCHEMA).parquet(path).select("repo", "issue_num", "label", "bucket")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def append_labels(labelled: DataFrame, path: str) -> None:
    """Append ``(repo, issue_num, label)`` rows; issue numbers are per repo,
    so the key is both.  Rows with a null label (the classifier abstained, Q10)
    are not written; an issue appears once per batch (callers pass one row per
    issue; should two labels arrive, the smallest name is kept, so the result
    never depends on task order); issues already in the sink are skipped (anti
    join on the key), so a replayed batch appends nothing twice.  The sink is
    partitioned by repo and range of numbers.  The batch's narrow rows are stored first,
    and the folders they fall into become a filter on the sink, so only those are listed and
    read; a batch that touches more than ``MOST_FOLDERS`` reads the sink by the join alone."""
    spark = labelled.sparkSession
    rows = (labelled.filter(F.col("label").isNotNull())
            .groupBy("repo", "issue_num").agg(F.min("label").alias("label"))
            .withColumn("bucket", F.floor(F.col("issue_num") / SINK_BUCKET).cast("int")))
    done = read_sink(spark, path)
    if done is not None:
        held = scratch_path(spark, "new-labels")
        rows.write.parquet(held)
        rows = spark.read.schema(rows.schema).parquet(held)
        keys = ["repo", "bucket", "issue_num"]
        rows = rows.join(in_folders_of(rows, done).select(*keys), keys, "left_anti")
    # A folder has at most SINK_BUCKET numbers, so one task writes it; dealt by number, every task would write a file to each.
    rows.repartition("repo", "bucket").write.mode("append").partitionBy("repo", "bucket").parquet(path)


def in_folders_of(rows: DataFrame, done: DataFrame, most: int = MOST_FOLDERS) -> DataFrame:
    """The sink's rows in the folders that ``rows`` fall into, as a filter on its partition columns."""
    folders = rows.select("repo", "bucket").distinct().limit(most + 1).collect()
    if len(folders) > most:
        return done
    by_repo: dict[str, list[int]] = {}
    for r in folders:
        by_repo.setdefault(r["repo"], []).append(r["bucket"])
    wanted = F.lit(False)
    for repo, buckets in sorted(by_repo.items(), key=str):
        wanted = wanted | ((F.col("repo") == repo) & F.col("bucket").isin(sorted(b for b in buckets if b is not None)))
    return done.filter(wanted)


def unlabelled_only(issues: DataFrame, labelled: DataFrame | None = None, id_col: str = "id",
                    labels_col: str | None = None) -> DataFrame:
    """Issues without labels.  Either the issue carries its label list
    (``labels_col``: null or empty means unlabelled) or a table of labelled
    ids is given (anti join on the id)."""
    if labels_col is not None:
        return issues.filter(F.col(labels_col).isNull() | (F.size(labels_col) == 0))
    return issues.join(labelled.select(id_col), id_col, "left_anti")


def recent_since(df: DataFrame, ts_col: str, as_of, delta_seconds: float) -> DataFrame:
    """Rows updated within ``delta_seconds`` before ``as_of`` (epoch
    seconds); ``as_of`` is a parameter so reruns are deterministic."""
    return df.filter(F.col(ts_col) >= F.lit(as_of - delta_seconds))
