"""Investigation records: saved views with the hashes that make them replayable."""

from __future__ import annotations

import datetime
import json
import uuid
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from planewise.conventions import RECORD_VERSION
from planewise.errors import CompatibilityError
from planewise.operators import ordered
from planewise.plans.bases import text_hash
from planewise.sources.bundle import content_hash


def _now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat()


@dataclass
class SavedView:
    name: str
    representation_id: str
    metric_id: str
    k: int
    view_id: str
    target_id: str | None = None
    note: str = ""
    path_kind: str = "linear_projection"
    semantically_valid: bool = True
    variance_explained: float | None = None
    id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    timestamp: str = field(default_factory=_now)
    metadata: dict[str, Any] = field(default_factory=dict)


@dataclass
class InvestigationRecord:
    bundle_id: str
    saved_views: list[SavedView] = field(default_factory=list)
    artifact_hashes: dict[str, str] = field(default_factory=dict)
    summary_note: str = ""
    schema_version: str = RECORD_VERSION
    software_version: str = RECORD_VERSION
    created_at: str = field(default_factory=_now)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> InvestigationRecord:
        """ValueError where the text isn't a record."""
        raw = json.loads(text)
        if not isinstance(raw, dict) or "bundle_id" not in raw or not isinstance(raw.get("saved_views", []), list):
            raise ValueError("not an investigation record")
        if raw.get("schema_version", RECORD_VERSION).split(".")[0] != RECORD_VERSION.split(".")[0]:
            raise ValueError(f"version {raw['schema_version']} can't be read")
        return cls(**{**raw, "saved_views": [SavedView(**v) for v in raw.get("saved_views", [])]})


def hashes(points: DataFrame, features: list[str]) -> dict[str, str]:
    """Hashes of the vectors, the features and the ids in their order (``id_tree``, a tree over blocks of ``pos``), without a row on the driver."""
    return {"matrix": content_hash(points.select("object_id", "vec")), "id_tree": ordered.root(ordered.blocks(points, ["object_id"])).first()[0], "features": text_hash(features)}


def check_replay(record: InvestigationRecord, now: dict[str, str], points: DataFrame | None = None) -> None:
    """CompatibilityError unless the record was made from these vectors, ids and features.

    Records that other tools wrote hold one running hash of the ids instead of a tree
    (``object_ids``); for those only, the ids of ``points`` stream through the driver.
    """
    if "object_ids" in record.artifact_hashes and points is not None:
        now = {**now, "object_ids": text_hash(r[0] for r in points.orderBy("pos").select("object_id").toLocalIterator())}
    for name, value in record.artifact_hashes.items():
        if now.get(name) != value:
            raise CompatibilityError(f"the record's {name} differ from the data's")


def markdown(title: str, facts: dict[str, Any], views: list[SavedView], basis: np.ndarray | None = None) -> str:
    """A report of the current view and the saved ones."""
    lines = [f"# {title}", "", f"Made {_now()}", "", "| fact | value |", "|---|---|", *(f"| {k} | {v} |" for k, v in facts.items())]
    if views:
        lines += ["", "## Saved views", "", "| name | view | metric | k | target | note |", "|---|---|---|---|---|---|", *(f"| {v.name} | {v.view_id} | {v.metric_id} | {v.k} | {v.target_id or ''} | {v.note} |" for v in views)]
    if basis is not None:
        lines += ["", "## Basis", "", *(" ".join(f"{x:.6f}" for x in row) for row in basis)]
    return "\n".join(lines) + "\n"
