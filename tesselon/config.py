"""Configuration: a YAML tree over defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

DEFAULTS: dict = {
    "base_url": "", "raw_dir": "data/raw", "processed_dir": "data/processed", "active_dataset": "default", "datasets": {"default": {"category": "Default"}},
    "preprocessing": {"k_core": 5, "min_rating_relevant": 4.0, "test_size": 0.2, "random_seed": 42, "split_protocol": "per_user_chronological_80_20", "dedup_policy": "latest"},
    "evaluation": {"k_values": [10]}, "hybrid": {"alpha": 0.5, "grid": [0.0, 0.25, 0.5, 0.75, 1.0], "validation_fraction": 0.1, "max_users": None, "max_val_rows": None, "calibration_max_rows": None},
    "ranking": {"negatives": 100, "seed": 42}, "categories": {"roots": [], "vocab_max": 256, "min_doc_freq": 5},
    "graph": {"dim": 64, "layers": 2, "epochs": 10, "lr": 0.005, "weight_decay": 0.0, "negatives": 1, "seed": 42, "validation_fraction": 0.1},
    "graph_analysis": {"min_shared_users": 3, "weight": "weight_jaccard", "top_n_items": None, "spectral_k": [10, 25, 50], "max_nodes": 500},
    "models": {"embedders": ["hash-32"], "sentiment": ["lexicon"]},
    "storage": {"vector_root": "data/storage/vectors", "graph_root": "data/storage/graph", "collection_prefix": "items", "password_env": "GRAPH_PASSWORD"},
}


def _merged(base: dict, over: dict) -> dict:
    return base | {k: _merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


@dataclass
class Config:
    tree: dict = field(default_factory=lambda: _merged(DEFAULTS, {}))

    @classmethod
    def load(cls, path: str | Path) -> Config:
        import yaml

        return cls(_merged(DEFAULTS, yaml.safe_load(Path(path).read_text()) or {}))

    def __getitem__(self, name: str):
        return self.tree[name]

    @property
    def dataset(self) -> dict:
        return self.tree["datasets"][self.tree["active_dataset"]]

    @property
    def k_core(self) -> int:
        """The dataset's own value, else that of all."""
        return int(self.dataset.get("k_core", self.tree["preprocessing"]["k_core"]))

    def url(self, kind: str) -> str:
        """Where the raw reviews ('review') or items ('meta') of the dataset lie."""
        prefix = "" if kind == "review" else "meta_"
        return f"{self.tree['base_url']}/{kind}_categories/{prefix}{self.dataset['category']}.jsonl.gz"

    def raw_path(self, kind: str) -> Path:
        prefix = "" if kind == "review" else "meta_"
        return Path(self.tree["raw_dir"]) / f"{prefix}{self.dataset['category']}.jsonl.gz"

    @property
    def collection(self) -> str:
        return f"{self.tree['storage']['collection_prefix']}_{self.tree['active_dataset']}_items"

    def password(self) -> str:
        name = self.tree["storage"]["password_env"]
        if not os.environ.get(name):
            raise RuntimeError(f"{name} is not set")
        return os.environ[name]
