"""Canonical documents and content digests of frames, windows and plans."""

from __future__ import annotations

import hashlib
import struct
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.functions.values import canonical_bytes, digest

FRAME_KEYS = ("risk_id", "run_id", "scenario_id", "corridor_id", "vessel_profile_id", "config_digest", "model_config_digest", "generation_id", "valid_time", "as_of_time", "generated_at", "model_version", "schema_version", "payload", "source_summary", "provenance")
#: Fields that do not count for a plan's identity (fixed sets): ids, request, clock, and computing time.
VOLATILE = ("plan_id", "layer_set_id", "planning_request_id", "generated_at")
VOLATILE_METRICS = ("compute_ms",)


def grid_digest(lats: list[float], lons: list[float]) -> str:
    """SHA-256 over both axes as little-endian 64-bit floats."""
    return hashlib.sha256(struct.pack(f"<{len(lats)}d", *lats) + struct.pack(f"<{len(lons)}d", *lons)).hexdigest()


def frame_digest(document: dict[str, Any]) -> str:
    """Digest of a frame's content: everything but its own id, sources in canonical order."""
    own = {k: v for k, v in document.items() if k != "risk_id"}
    own["source_summary"] = sorted(own.get("source_summary", []), key=canonical_bytes)
    return digest(own)


def canonical_risk_id(document: dict[str, Any]) -> str:
    return f"risk-sha256-{frame_digest(document)}"


def window_digest(query: dict[str, Any], documents: list[dict[str, Any]]) -> str:
    return digest({"query": query, "frames": documents})


def plan_digest(plan: dict[str, Any]) -> str:
    """Digest of what a plan says, without ids, request, clock and effort."""
    own = {k: v for k, v in plan.items() if k not in VOLATILE}
    if isinstance(own.get("metrics"), dict):
        own["metrics"] = {k: v for k, v in own["metrics"].items() if k not in VOLATILE_METRICS}
    return digest(own)


def set_digest(plans: list[dict[str, Any]], **head: Any) -> str:
    return digest(head | {"plans": sorted(plan_digest(p) for p in plans)})


def strict_fields(document: dict[str, Any], expected: frozenset[str] | set[str], name: str) -> list[str]:
    """What is missing and what is too much, both."""
    return [f"{name}: missing {k}" for k in sorted(expected - set(document))] + [f"{name}: unknown {k}" for k in sorted(set(document) - expected)]


def frame_documents(cube: DataFrame, headers: DataFrame) -> DataFrame:
    """(frame, document, content_digest): cells of a frame as row-major arrays under its header.

    A frame's cells are bounded by the grid; they meet in one row of a
    grouped aggregation and one Arrow batch makes the canonical text.
    """
    cell = F.struct("row", "col", "lat", "lon", "risk", "hard", "confidence", "factor")
    packed = cube.groupBy("frame").agg(F.sort_array(F.collect_list(cell)).alias("cells")).join(headers, "frame")

    @F.pandas_udf("struct<document:string,content_digest:string>")
    def encode(head: pd.Series, cells: pd.Series) -> pd.DataFrame:
        import json

        rows = []
        for h, cs in zip(head, cells, strict=True):
            lats = sorted({float(c["lat"]) for c in cs})
            lons = sorted({float(c["lon"]) for c in cs})
            n = len(lons)
            grid = lambda f, cs=cs, n=n: [[f(c) for c in cs[i : i + n]] for i in range(0, len(cs), n)]
            unknown = lambda c: c["risk"] is None or c["risk"] != c["risk"]
            document = json.loads(h) | {
                "payload": {
                    "coordinates": {"latitude": lats, "longitude": lons},
                    "variables": {
                        "risk_score": grid(lambda c: None if unknown(c) else float(c["risk"])),
                        "risk_level": grid(lambda c: 5 if unknown(c) else min(5, max(1, int(c["risk"] * 5) + 1))),
                        "hard_mask": grid(lambda c: bool(c["hard"])),
                        "confidence": grid(lambda c: float(c["confidence"])),
                        "environment_speed_factor": grid(lambda c: float(c["factor"])),
                    },
                    "attributes": {},
                }
            }
            document["risk_id"] = canonical_risk_id(document)
            rows.append((canonical_bytes(document).decode(), frame_digest(document)))
        return pd.DataFrame(rows, columns=["document", "content_digest"])

    head = F.to_json(F.struct(*(c for c in headers.columns if c != "frame")))
    return packed.select("frame", encode(head, F.col("cells")).alias("d")).select("frame", "d.document", "d.content_digest")


DOCUMENT = "risk_id string, run_id string, generation_id int, valid_time string, payload struct<coordinates:struct<latitude:array<double>,longitude:array<double>>,variables:struct<risk_score:array<array<double>>,risk_level:array<array<int>>,hard_mask:array<array<boolean>>,confidence:array<array<double>>,environment_speed_factor:array<array<double>>>>"


def cells_of(documents: DataFrame, column: str = "document") -> DataFrame:
    """Cells (risk_id, row, col, lat, lon, risk, level, hard, confidence, factor) of frame documents."""
    d = documents.select(F.from_json(column, DOCUMENT, {"mode": "FAILFAST"}).alias("d")).select("d.risk_id", "d.valid_time", "d.payload.*")
    rows = d.select("risk_id", "valid_time", "coordinates", "variables", F.posexplode("coordinates.latitude").alias("row", "lat"))
    cells = rows.select("risk_id", "valid_time", "variables", "row", "lat", F.posexplode("coordinates.longitude").alias("col", "lon"))

    def at(name: str) -> Column:
        return F.col(f"variables.{name}")[F.col("row")][F.col("col")]

    return cells.select("risk_id", "valid_time", "row", "col", "lat", "lon", at("risk_score").alias("risk"), at("risk_level").alias("level"), at("hard_mask").alias("hard"), at("confidence").alias("confidence"), at("environment_speed_factor").alias("factor"))


def tampered(documents: DataFrame, column: str = "document") -> DataFrame:
    """Documents whose id does not follow from their content, or with fields missing or unknown."""

    @F.pandas_udf("string")
    def problem(texts: pd.Series) -> pd.Series:
        import json

        out = []
        for text in texts:
            try:
                d = json.loads(text)
            except (TypeError, ValueError):
                out.append("not JSON")
                continue
            wrong = strict_fields(d, set(FRAME_KEYS), "frame")
            out.append("; ".join(wrong) or (None if d["risk_id"] == canonical_risk_id(d) else "id does not match content"))
        return pd.Series(out, dtype=object)

    return documents.withColumn("problem", problem(column)).where("problem is not null")
