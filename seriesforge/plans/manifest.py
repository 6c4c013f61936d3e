"""Manifests of batch runs: loading, checking, defaults and merging."""

from __future__ import annotations

import copy

DEFAULTS = {
    "freq": None,
    "value_cols": [],
    "clean": {"auto_detect": True, "apply_operations": []},
    "normalization": {"enabled": False, "rules": {}, "enrichment_columns": [], "hierarchy_levels": []},
    "deviations": {"lookback_window": "90d", "sensitivity": "medium"},
    "correlate": False,
}
REQUIRED = ("data_path", "dataset_name", "timestamp_col")


def merge(base: dict, edit: dict) -> dict:
    """``base`` with ``edit`` laid over it, mappings merged key by key."""
    out = copy.deepcopy(base)
    for k, v in edit.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def check(manifest: dict) -> dict:
    """The manifest with defaults; raises where something is missing or unknown."""
    missing = [k for k in REQUIRED if not manifest.get(k)]
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")
    scenarios = manifest.get("scenarios") or []
    if not scenarios:
        raise ValueError("at least one scenario is needed")
    out = merge(DEFAULTS, manifest)
    out["scenarios"] = []
    for s in scenarios:
        if not s.get("segment_by"):
            raise ValueError(f"scenario {s.get('name')} has no segment_by")
        by = s["segment_by"]
        out["scenarios"].append({"name": s.get("name") or str(by), "segment_by": [by] if isinstance(by, str) else list(by), "min_segment_size": s.get("min_segment_size", 50)})
    if out["deviations"]["sensitivity"] not in ("low", "medium", "high"):
        raise ValueError("sensitivity is low, medium or high")
    return out


def load(text: str) -> dict:
    import yaml

    return check(yaml.safe_load(text) or {})


def duration_days(text: str) -> float:
    """90d, 12w, 36h or a number of days."""
    text = str(text).strip().lower()
    unit = {"d": 1.0, "w": 7.0, "h": 1 / 24}.get(text[-1:])
    return float(text[:-1]) * unit if unit else float(text)


def from_profile(dataset: str, path: str, ts: str, values: list[str], candidates: dict[str, int]) -> dict:
    """A manifest with one scenario for each column that makes more than one segment."""
    scenarios = [{"name": f"by_{c}", "segment_by": c} for c, n in candidates.items() if n > 1]
    return check({"data_path": path, "dataset_name": dataset, "timestamp_col": ts, "value_cols": values, "scenarios": scenarios})
