"""The preprocessing pipeline: landed records to split tables and a summary."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from tesselon.operators import eda, prep
from tesselon.session import store_table
from tesselon.sources.files import joined, write_json
from tesselon.sources.records import table_dir, write_tables


def preprocess(records: DataFrame, metadata: DataFrame, root: str | Path, dataset: str, *, k: int = 5, protocol: str = "per_user_chronological_80_20", policy: str = "latest", test_size: float = 0.2, seed: int = 42, relevant_from: float = 4.0) -> dict:
    """Writes interactions, train, test, (validation,) metadata and eda_summary.json; gives the summary."""
    counts = prep.raw_and_kept(records).first()
    deduped = store_table(prep.deduplicate(prep.load_interactions(records), policy))
    core = store_table(prep.k_core(deduped, k))
    if protocol == "leave_last_out":
        split = store_table(prep.split_leave_last_out(core))
    elif protocol == "per_user_chronological_80_20":
        split = store_table(prep.split_per_user(core, test_size, seed))
    else:
        raise ValueError(f"unknown split protocol: {protocol!r}")
    parts = {p: split.where(F.col("part") == p).drop("part") for p in ("train", "test", *(["validation"] if protocol == "leave_last_out" else []))}
    items = prep.restrict(metadata, core, "parent_asin")
    folder = table_dir(root, dataset, protocol)
    write_tables(folder, interactions=core, metadata=items, **parts)
    summary = {"raw_rows": counts["raw"], "valid_rows": counts["kept"], "split_protocol": protocol}
    for prefix, df in (("dedup", deduped), ("kcore", core)):
        summary |= eda.table_facts(df, prefix, relevant_from).first().asDict()
    summary |= {f"{p}_rows": df.count() for p, df in parts.items()}
    hist = lambda df: {str(r["rating"]): r["n"] for r in eda.rating_histogram(df).orderBy("rating").collect()}
    summary["rating_histogram_dedup"], summary["rating_histogram"] = hist(deduped), hist(core)
    summary["test_items_not_in_train"] = eda.only_in(parts["test"], parts["train"], "parent_asin").first()["n"]
    summary |= eda.missingness(items).first().asDict()
    write_json(metadata.sparkSession, joined(folder, "eda_summary.json"), summary)
    return summary
