"""Policies and registries in YAML files, checked when they are read."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession


def document(spark: SparkSession, path: str) -> dict[str, Any]:
    """A YAML file at any path that Spark reads; it must hold a mapping."""
    found = yaml.safe_load(spark.read.text(path, wholetext=True).first().value)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def _known(kind: type, found: dict[str, Any]):
    """A flat policy from those keys that it knows; others are for other readers, missing ones keep their defaults."""
    return kind(**{f.name: found[f.name] for f in fields(kind) if f.name in found})


# fixed values: the keys of policy files and what holds where a file leaves one out
@dataclass(frozen=True)
class CompletenessPolicy:
    """Widths, corrections and least counts of completeness estimates."""

    bin_width_magnitude: float = 0.1
    maximum_curvature_correction_magnitude: float = 0.2
    supported_minimum_events: int = 200
    high_uncertainty_minimum_events: int = 100
    research_only_minimum_events: int = 50
    goodness_of_fit_target_confidence_percent: float = 95.0
    goodness_of_fit_fallback_confidence_percent: float = 90.0
    goodness_of_fit_minimum_events_above_candidate: int = 10
    goodness_of_fit_minimum_bins_above_candidate: int = 10
    emr_bootstrap_resamples: int = 200
    emr_bootstrap_seed: int = 20260816
    emr_confidence_level_percent: float = 95.0

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> CompletenessPolicy:
        return _known(cls, document(spark, path))


@dataclass(frozen=True)
class ClassifierPolicy:
    """Parameters of tectonic classes, as ``grid.classify`` takes them."""

    interface_half_width_km: float = 10.0
    default_event_depth_uncertainty_km: float = 15.0
    default_slab_uncertainty_km: float = 10.0
    default_slab_thickness_km: float = 60.0
    maximum_crustal_depth_km: float = 50.0
    minimum_label_probability: float = 0.60

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> ClassifierPolicy:
        return _known(cls, document(spark, path))


@dataclass(frozen=True)
class ForecastSpecification:
    """Grid, horizons in seconds, magnitude bins (lower, upper or None, status), and what is not estimated."""

    version: int
    status: str
    grid_id: str
    horizons: dict[str, float]
    bins: tuple[tuple[float, float | None, str], ...]
    reject_threshold_below_mc: bool = True
    stale_data_action: str = "not_estimable"

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> ForecastSpecification:
        found = document(spark, path)
        bins = tuple((float(b["lower"]), None if b.get("upper") is None else float(b["upper"]), b.get("status", "active")) for b in found["magnitude_bins"])
        horizons = {h["id"]: float(h["seconds"]) for h in found["horizons"]}
        limits = found.get("estimability", {})
        return cls(found["version"], found["status"], found["grid"]["id"], horizons, bins, bool(limits.get("reject_threshold_below_mc", True)), limits.get("stale_data_action", "not_estimable"))

    def seconds(self, horizon: str) -> float:
        if horizon not in self.horizons:
            raise ValueError(f"unknown horizon {horizon!r}; there are {sorted(self.horizons)}")
        return self.horizons[horizon]

    def bounds(self) -> tuple[tuple[float, float | None], ...]:
        """The bins, as ``grid.assign_bins`` takes them."""
        return tuple((low, high) for low, high, _ in self.bins)


def _closed(found: dict[str, Any], names: set[str], what: str) -> None:
    if set(found) != names:
        raise ValueError(f"{what}: missing {sorted(names - set(found))}, unknown {sorted(set(found) - names)}")


def source_registry(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, position, role, license, stability, enabled, endpoints) in the file's order.

    A source must name its id, authority, role, endpoints (each with a kind), license and stability, and whether
    it is enabled; its other keys are left to other readers. The first of several sources of one id is the one."""
    found, rows = document(spark, path), {}
    _closed(found, {"version", "reviewed_at", "sources"}, path)
    for k, s in enumerate(found["sources"]):
        lacking = {"id", "authority", "role", "endpoints", "license", "stability", "enabled"} - set(s)
        if lacking or any("kind" not in e for e in s["endpoints"]):
            raise ValueError(f"source {s.get('id')!r} lacks {sorted(lacking) or ['kind']}")
        if not isinstance(s["enabled"], bool):
            raise ValueError(f"source {s['id']!r} is enabled or not")
        rows.setdefault(s["id"], (s["id"], k, s["role"], s["license"], s["stability"], s["enabled"], [e["kind"] for e in s["endpoints"]]))
    return spark.createDataFrame(list(rows.values()), "source_id string, position int, role string, license string, stability string, enabled boolean, endpoints array<string>")


def asset_registry(spark: SparkSession, path: str) -> DataFrame:
    """(release_id, source_id, type, name, url, bytes, sha256) of pinned assets, as ``assets.acquire`` takes them.

    Releases have different ids and their assets different types; a length is positive, a digest 64 hex digits."""
    found, rows = document(spark, path), []
    _closed(found, {"version", "reviewed_at", "releases"}, path)
    names = [r["id"] for r in found["releases"]]
    if len(set(names)) != len(names):
        raise ValueError("releases must have different ids")
    for release in found["releases"]:
        kinds = [a["type"] for a in release["assets"]]
        if len(set(kinds)) != len(kinds):
            raise ValueError(f"the assets of {release['id']!r} must have different types")
        for a in release["assets"]:
            _closed(a, {"type", "filename", "url", "byte_length", "sha256"}, f"asset {a.get('type')!r}")
            if not (isinstance(a["byte_length"], int) and a["byte_length"] > 0) or not re.fullmatch("[a-f0-9]{64}", str(a["sha256"])):
                raise ValueError(f"asset {a['type']!r} has no length or digest")
            rows.append((release["id"], release["source_id"], a["type"], a["filename"], a["url"], a["byte_length"], a["sha256"]))
    return spark.createDataFrame(rows, "release_id string, source_id string, type string, name string, url string, bytes long, sha256 string")
