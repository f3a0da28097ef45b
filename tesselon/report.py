"""Data products of the dashboard: tables and JSON, no drawing."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from tesselon.sources.files import write_json

#: Metric columns as the dashboard names them.
METRIC_NAMES = {"precision_at_k": "precision_at_10", "recall_at_k": "recall_at_10", "f1_at_k": "f1_at_10"}


def search_items(items: DataFrame, pattern: str, columns: Sequence[str] = ("title", "display_category", "store")) -> DataFrame:
    """Rows in which any of the columns matches the pattern, without regard to case; nulls match nothing, '' gives all rows."""
    if not pattern:
        return items
    any_ = F.lit(False)
    for c in columns:
        any_ = any_ | F.coalesce(F.col(c).rlike("(?i)" + pattern), F.lit(False))
    return items.where(any_)


def metric_table(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The model label and those of the metric columns that exist, renamed for display; names that are absent do nothing."""
    kept = [c for c in ("model", *columns) if c in metrics.columns]
    return metrics.select(*kept).withColumnsRenamed(METRIC_NAMES)


def histogram_order(hist: DataFrame, key: str) -> DataFrame:
    """Rows in the numeric order of string keys."""
    return hist.orderBy(F.col(key).try_cast("double"))


def graph_sample(nodes: DataFrame, edges: DataFrame, max_nodes: int = 300, max_edges: int = 2000) -> tuple[DataFrame, DataFrame]:
    """At most ``max_nodes`` nodes of the highest degree and ``max_edges`` edges of the greatest weight among them."""
    kept = nodes.orderBy(F.desc("degree"), "id").limit(max_nodes)
    ids = kept.select("id")
    inside = edges.join(ids, F.col("source") == F.col("id"), "left_semi").join(ids, F.col("target") == F.col("id"), "left_semi")
    return kept, inside.orderBy(F.desc("weight"), "source", "target").limit(max_edges)


def small_rows(df: DataFrame, max_rows: int = 100_000) -> list[dict]:
    """A small table's rows; more than ``max_rows`` raise instead of filling the driver."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    return [r.asDict(recursive=True) for r in rows]


def to_json(df: DataFrame, path: str | Path, max_rows: int = 100_000) -> None:
    """A small table as a JSON array."""
    write_json(df.sparkSession, str(path), small_rows(df, max_rows))


def load_dashboard(local: str | Path, demo: str | Path, names: Sequence[str]) -> dict:
    """Each artifact from the local folder, else from the demo folder, else None with a note; the mode is 'local' if eda_summary.json is there."""
    local, demo = Path(local), Path(demo)
    out: dict = {"mode": "local" if (local / "eda_summary.json").exists() else "demo", "notes": []}
    for name in names:
        path = next((p for p in (local / f"{name}.json", demo / f"{name}.json") if p.exists()), None)
        out[name] = json.loads(path.read_text()) if path else None
        if path is None:
            out["notes"].append(f"{name} is missing")
        elif path.parent == demo and out["mode"] == "local":
            out["notes"].append(f"{name} comes from the demo data")
    return out
