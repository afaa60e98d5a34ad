"""Results to files, and proposal caches that are valid for one table only."""

from __future__ import annotations

import json
import math
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRIVATE = ("active_oracle_label", "queried_for_calibration", "cell_confidence", "confidence")


def workspace(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in one process."""
    context = spark.sparkContext
    known = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not known and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (known or "file://" + tempfile.mkdtemp(prefix="veracell-")).rstrip("/")


def write_scores(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Scores, highest first within the files' global order."""
    df.orderBy(F.desc("posterior"), "row_idx", "column").write.mode("overwrite").format(fmt).option("header", True).save(path)


def write_explanations(df: DataFrame, path: str, audit: bool = False) -> None:
    """A JSON object a line; labels and confidences only in the audit file."""
    cols = [c for c in df.columns if audit or c not in PRIVATE]
    safe = [F.when(F.isnan(F.col(c)), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes if c in cols]
    df.select(F.to_json(F.struct(*safe)).alias("value")).write.mode("overwrite").text(path)


def write_repairs(candidates: DataFrame, path: str) -> None:
    candidates.select(F.concat_ws("::", F.col("row_idx").cast("string"), "column").alias("cell_key"), "row_idx", "column", "rank", "mechanism", "candidate", "score", *[c for c in ("ambiguity", "changed") if c in candidates.columns]).write.mode("overwrite").option("header", True).csv(path)


def plain(x):
    """JSON-safe: numbers that JSON lacks become null, keys strings."""
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [plain(v) for v in x]
    return x


def write_json(path: str, payload: dict) -> None:
    """Whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=folder, suffix=".tmp")
    with os.fdopen(fd, "w") as f:
        json.dump(plain(payload), f, sort_keys=True, indent=1)
    os.replace(tmp, path)


class ProposalCache:
    """A JSON file of proposals (rules, plans, queries) bound to a table's columns
    and fingerprint; anything else in its place is ignored."""

    def __init__(self, path: str, kind: str, version: int = 1):
        self.path, self.kind, self.version = path, kind, version

    def save(self, columns: list[str], fingerprint: str, items: list, **settings) -> None:
        write_json(self.path, {"kind": self.kind, "version": self.version, "columns": columns, "fingerprint": fingerprint, "settings": settings, "items": items})

    def load(self, columns: list[str], fingerprint: str, **settings) -> list | None:
        try:
            with open(self.path) as f:
                d = json.load(f)
        except (OSError, ValueError):
            return None
        same = (d.get("kind"), d.get("version"), d.get("columns"), d.get("fingerprint"), d.get("settings")) == (self.kind, self.version, columns, fingerprint, plain(settings))
        return d.get("items") if same else None


class RunLog:
    """The last rounds of a refinement in full, older ones as counts."""

    def __init__(self, keep: int = 20, fold: int = 5):
        self.keep, self.fold, self.entries, self.summaries = keep, fold, [], []

    def add(self, **entry) -> None:
        self.entries.append(entry)
        if len(self.entries) > self.keep:
            old, self.entries = self.entries[: self.fold], self.entries[self.fold :]
            self.summaries.append({"rounds": len(old), "taken": sum(bool(e.get("taken")) for e in old)})
