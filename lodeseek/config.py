"""Settings: defaults, a YAML or JSON file over them, and dotted overrides over both."""

from __future__ import annotations

import copy
import json
from pathlib import Path
from typing import Any

DEFAULTS: dict[str, Any] = {
    "embedding_model": {"backend": "lsa", "name": "", "fallback_to_lsa": True, "lsa_dim": 128, "fit_rows": 10_000, "max_terms": 20_000},
    "representation": "contextual",
    "chunking": {"max_chunk_lines": 60, "max_file_bytes": 1_000_000},
    "query": {"expand_concepts": True, "classify": True},
    "retrieval": {"dense_top_k": 100, "bm25_top_k": 100, "identifier_top_k": 50, "candidate_size": 100, "dense_weight": 0.55, "bm25_weight": 0.30, "identifier_weight": 0.15, "fusion": "weighted", "category_weights": True},
    "vector_index": {"ann": "none", "flat_threshold": 2000, "recall": 0.95},
    "index": {"dir": "indexes"},
    "ranking": {"reranker": "linear", "rerank_top_n": 50, "weights": {"semantic": 0.50, "bm25": 0.20, "identifier": 0.10, "metadata": 0.10, "structural": 0.10}, "use_structural": True},
    "dedup": {"enabled": True, "similarity_threshold": 0.90},
}


def parse_override(text: str) -> tuple[str, Any]:
    """``a.b=value`` to its key and value; the value is JSON where it parses, else a string."""
    key, _, value = text.partition("=")
    try:
        return key, json.loads(value)
    except ValueError:
        return key, value


def load_config(path: str | None = None, overrides: dict[str, Any] | None = None) -> dict[str, Any]:
    """A missing file is a FileNotFoundError; a YAML file needs the yaml library, JSON doesn't."""
    config = copy.deepcopy(DEFAULTS)
    if path:
        text = Path(path).read_text()
        if path.endswith(".json"):
            given = json.loads(text)
        else:
            import yaml

            given = yaml.safe_load(text)
        _merge(config, given or {})
    for dotted, value in (overrides or {}).items():
        *parents, last = dotted.split(".")
        place = config
        for parent in parents:
            place = place.setdefault(parent, {})
        place[last] = value
    return config


def _merge(into: dict, given: dict) -> None:
    for key, value in given.items():
        if isinstance(value, dict) and isinstance(into.get(key), dict):
            _merge(into[key], value)
        else:
            into[key] = value
