"""Spans of nodes as JSON lines.

Nodes are lazy, so a span's duration is that of building the plan unless rows
are materialised.  ``off``: nothing; ``build``: spans; ``observe``: also row
counts, gathered by the run itself through observed metrics; ``materialize``:
each node is persisted and counted (for debugging).
"""

from __future__ import annotations

import json
import re
import sys
import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

MODES = ("off", "build", "observe", "materialize")


def span_name(op: str, trace_key: str = "") -> str:
    return f"{op}({trace_key})" if trace_key else op


def prefixed_key(prefix: str, child: str) -> str:
    return "::".join(x for x in (prefix, child) if x)


def module_prefix(path: str) -> str:
    """The file name of a module path without its last extension."""
    name = re.split(r"[/\\]", path)[-1]
    stem, dot, _ = name.rpartition(".")
    return stem if dot and stem else name


class Tracer:
    def __init__(self, mode: str = "off", write: Callable[[str], None] | None = None):
        if mode not in MODES:
            raise ValueError(f"unknown trace mode {mode}")
        self.mode = mode
        self.write = write or (lambda line: print(line, file=sys.stdout, flush=True))
        self.observed: dict[str, Observation] = {}
        self._kept: list[DataFrame] = []

    def _base(self, event: str, plan: str, node) -> dict:
        out = {"event": event, "plan_name": plan, "node_id": node.id, "op": node.op, "span_name": span_name(node.op, node.trace_key)}
        if node.trace_key:
            out["trace_key"] = node.trace_key
        if node.op == "py:module" and isinstance(node.params.get("module"), str):
            out |= {"trace_prefix": module_prefix(node.params["module"]), "module_file": node.params["module"]}
        return out

    def run(self, plan: str, node, inputs: list[DataFrame], make: Callable[[], DataFrame]) -> DataFrame:
        if self.mode == "off":
            return make()
        self.write(json.dumps(self._base("node_start", plan, node)))
        end, began = self._base("node_end", plan, node), time.perf_counter()
        try:
            df = make()
            if self.mode == "observe":
                seen = self.observed[node.id] = Observation(node.id)
                df = df.observe(seen, F.count(F.lit(1)).alias("rows_out"))
            elif self.mode == "materialize":
                end["rows_in"] = sum(x.count() for x in inputs)
                df = df.persist(StorageLevel.MEMORY_AND_DISK)
                self._kept.append(df)
                end["rows_out"] = df.count()
            return df
        except Exception as e:
            end["error"] = str(e)
            raise
        finally:
            end["duration_ms"] = round((time.perf_counter() - began) * 1000, 3)
            self.write(json.dumps(end))

    def counts(self) -> dict[str, int]:
        """Rows out of each observed node that the finished action ran."""
        return {k: o.get["rows_out"] for k, o in self.observed.items()}

    def release(self) -> None:
        for df in self._kept:
            df.unpersist()
        self._kept.clear()
