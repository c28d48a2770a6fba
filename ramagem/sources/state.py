"""Progress of a pipeline: the last finished phase of each source, published as one small file."""

from __future__ import annotations

import json
import time

from pyspark.sql import SparkSession

from ramagem.sources import shared

PHASES = ("harvested", "flattened", "enriched", "labelled")


class PipelineState:
    """phase(name) is 0 for a new source up to 4 for a finished one; finish() records the next one. Survives restarts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _load(self) -> dict[str, dict]:
        return json.loads(shared.read_text(self.spark, self.path) or "{}")

    def phase(self, name: str) -> int:
        return self._load().get(name, {}).get("phase", 0)

    def finish(self, name: str, phase: int, **paths: str) -> None:
        if not 1 <= phase <= len(PHASES):
            raise ValueError(f"no phase {phase}")
        held = self._load()
        entry = held.setdefault(name, {"paths": {}})
        entry |= {"phase": max(phase, entry.get("phase", 0)), "updated_at": time.time(), "paths": entry["paths"] | paths}
        shared.publish_text(self.spark, self.path, json.dumps(held))

    def todo(self, names: list[str], phase: int) -> list[str]:
        """Sources that have not finished a phase."""
        held = self._load()
        return [n for n in names if held.get(n, {}).get("phase", 0) < phase]
