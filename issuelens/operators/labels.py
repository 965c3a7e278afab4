"""Label maps: raw issue label -> class (P2/J4), drop others (P3), whitelist."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Class codes.
CLASSES = {"feature": 0, "bug": 1, "doc": 2, "others": -1}
CLASS_ORDER = ("feature", "bug", "doc")  # precedence when a raw label is in two classes

# The label maps for the reference's own repos (seen = training
# repos, unseen = test repos).
REFERENCE_LABEL_MAP: dict[str, dict[str, dict[str, list[str]]]] = {
    "seen": {
        "tensorflow": {"feature": ["type:feature"], "bug": ["type:bug"],
                       "doc": ["type:docs-feature", "type:docs-bug"]},
        "rust": {"feature": ["C-feature-request", "C-feature-accepted", "C-enhancement"],
                 "bug": ["C-bug"], "doc": ["T-doc"]},
        "kubernetes": {"feature": ["kind/feature", "kind/api-change"], "bug": ["kind/bug"],
                       "doc": ["kind/documentation"]},
    },
    "unseen": {
        "flutter": {"feature": ["severe: new feature"],
                    "bug": ["severe: crash", "severe: fatal crash", "severe: rendering"],
                    "doc": ["documentation"]},
        "ohmyzsh": {"feature": ["Feature", "Enhancement"], "bug": ["Bug"],
                    "doc": ["Type: documentation"]},
        "electron": {"feature": ["enhancement :sparkles:"],
                     "bug": ["bug :beetle:", "crash :boom:"],
                     "doc": ["documentation :notebook:"]},
    },
}


# The corpus profile (A12, T3) counts more labels than the map does:
# extra labels of a class, and the class of labels nobody names (others but those listed).
REFERENCE_PROFILE_RULES: dict[str, dict] = {
    "kubernetes": {"extra": {"kind/failing-test": "bug"}},
    "tensorflow": {"default": "bug", "other": ["type:others"]},
}


def fixture_profile_rules() -> dict[str, dict]:
    """The same kinds of rule for the derived ``issues`` view."""
    return {"repo1": {"extra": {"C-cleanup": "bug"}}, "repo2": {"default": "bug", "other": ["C-discussion"]}}


def profile_class(mapping: Mapping, rules: Mapping[str, Mapping], repo: str = "repo", raw: str = "labels") -> Column:
    """Class name of an issue in the corpus profile: the map's class, else the repo's
    rules, else ``other``.  Both are configuration of a few dozen entries."""
    names = {code: name for name, code in CLASSES.items()}
    r, label = F.col(repo), F.col(raw)
    expr = F.when(F.lit(False), F.lit("other"))
    for _, rp, raw_label, code in label_map_rows(mapping):
        expr = expr.when((r == rp) & (label == raw_label), F.lit(names[code]))
    for rp, rule in sorted(rules.items()):
        for raw_label, name in rule.get("extra", {}).items():
            expr = expr.when((r == rp) & (label == raw_label), F.lit(name))
        if "default" in rule:
            named = F.coalesce(label.isin(list(rule.get("other", []))), F.lit(False))
            expr = expr.when((r == rp) & ~named, F.lit(rule["default"]))
    return expr.otherwise(F.lit("other"))


def fixture_label_map() -> dict[str, dict[str, dict[str, list[str]]]]:
    """Label map of the derived ``issues`` view: ``C-`` labels for the seen
    repos, ``kind/`` labels for the unseen ones; discussion/cleanup unmapped."""
    def repo_map(prefix: str) -> dict[str, list[str]]:
        return {"feature": [f"{prefix}enhancement", f"{prefix}feature"],
                "bug": [f"{prefix}bug"], "doc": [f"{prefix}doc"]}
    return {"seen": {f"repo{i}": repo_map("C-") for i in range(3)},
            "unseen": {f"repo{i}": repo_map("kind/") for i in range(3, 6)}}


def label_map_rows(mapping: Mapping[str, Mapping[str, Mapping[str, Sequence[str]]]]
                   ) -> list[tuple[str, str, str, int]]:
    """Flatten to ``(split, repo, raw_label, label)``; the first class listed in
    ``CLASS_ORDER`` wins when a raw label appears under two classes."""
    rows: dict[tuple[str, str], tuple[str, str, str, int]] = {}
    for split, repos in mapping.items():
        for repo, classes in repos.items():
            for cls in CLASS_ORDER:
                for raw in classes.get(cls, []):
                    rows.setdefault((repo, raw), (split, repo, raw, CLASSES[cls]))
    return sorted(rows.values())


def label_map_frame(spark: SparkSession, mapping=None) -> DataFrame:
    """The map as a small DataFrame; its size is fixed by configuration."""
    rows = label_map_rows(mapping or fixture_label_map())
    return spark.createDataFrame(rows, "split STRING, repo STRING, raw_label STRING, label INT")


def repo_splits(mapping=None) -> dict[str, str]:
    return {repo: split for split, repos in (mapping or fixture_label_map()).items() for repo in repos}


def whitelist(mapping=None) -> list[str]:
    """Every raw label that some class maps (the duplicate-check whitelist)."""
    return sorted({r[2] for r in label_map_rows(mapping or fixture_label_map())})


def split_of(repo: Column, mapping=None) -> Column:
    """``seen``/``unseen`` for a repo column (null for repos outside the map)."""
    expr = None
    for repo_name, split in sorted(repo_splits(mapping).items()):
        cond = repo == F.lit(repo_name)
        expr = F.when(cond, F.lit(split)) if expr is None else expr.when(cond, F.lit(split))
    return expr


def standardise_labels(df: DataFrame, label_map: DataFrame, raw_col: str = "labels",
                       out_col: str = "label") -> DataFrame:
    """Broadcast left join on (repo, raw label); unmapped -> -1.

    The map is configuration (tens of rows), so broadcasting it is safe at any
    data size and the issue side never shuffles.
    """
    m = label_map.select(F.col("repo").alias("_m_repo"), F.col("raw_label").alias("_m_raw"),
                         F.col("label").alias("_m_label"))
    joined = df.join(F.broadcast(m), (df["repo"] == m["_m_repo"]) & (df[raw_col] == m["_m_raw"]), "left")
    return joined.withColumn(out_col, F.coalesce(F.col("_m_label"), F.lit(-1))).drop(
        "_m_repo", "_m_raw", "_m_label")


def remove_other_class(df: DataFrame, col: str = "label") -> DataFrame:
    """Keep rows of the three classes."""
    return df.filter(F.col(col) != -1)


def whitelist_labels(df: DataFrame, labels: Iterable[str], col: str = "labels") -> DataFrame:
    """Keep rows whose raw label is whitelisted (a literal IN-set)."""
    return df.filter(F.col(col).isin(list(labels)))


def assemble_dataset(issues: DataFrame, label_map: DataFrame, mapping=None) -> DataFrame:
    """P2 + P3 + split tag: the labelled dataset over seen and unseen repos."""
    ds = remove_other_class(standardise_labels(issues, label_map))
    return ds.withColumn("split", split_of(F.col("repo"), mapping))
