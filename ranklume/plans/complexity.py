"""How complex a plan is, and whether a budget allows it.

Plans have at most a few thousand nodes, so this runs on the driver.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from pathlib import Path

from .plan import Plan, PlanNode

TOP = 5
SHOWN = 6  # of a long path


@dataclass(frozen=True)
class Metrics:
    node_count: int = 0
    edge_count: int = 0
    max_depth: int = 0
    fanout_peak: int = 0
    fanin_peak: int = 0
    top_fanout: tuple[tuple[str, str, int], ...] = ()
    top_fanin: tuple[tuple[str, str, int], ...] = ()
    longest_path: tuple[str, ...] = ()


@dataclass(frozen=True)
class Weights:
    node_count: float = 1.0
    max_depth: float = 5.0
    fanout_peak: float = 2.0
    fanin_peak: float = 2.0
    edge_count: float = 0.5


# Default limits; 0 is no limit.
@dataclass(frozen=True)
class Budget:
    node_count: int = 2000
    max_depth: int = 120
    fanout_peak: int = 16
    fanin_peak: int = 16
    edge_count: int = 10000
    complexity_score: int = 8000
    weights: Weights = field(default_factory=Weights)

    @classmethod
    def of(cls, document: dict) -> Budget:
        """A budget from its JSON form; what is missing keeps its default."""
        given = {k: int(v) for part in ("hard", "soft") for k, v in document.get(part, {}).items() if k in cls.__dataclass_fields__ and k != "weights"}
        return replace(cls(), **given, weights=replace(Weights(), **{k: float(v) for k, v in document.get("score_weights", {}).items() if k in Weights.__dataclass_fields__}))

    @classmethod
    def load(cls, path: str | Path) -> Budget:
        return cls.of(json.loads(Path(path).read_text(encoding="utf-8")))


@dataclass(frozen=True)
class Verdict:
    passed: bool
    violations: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()
    diagnostics: str = ""

    @property
    def error_code(self) -> str:
        return "" if self.passed else "PLAN_TOO_COMPLEX"


def order(nodes: Iterable[PlanNode]) -> list[str]:
    """Ids in the order in which they become ready, first in plan order; a cycle's nodes are missing."""
    nodes = list(nodes)
    dependents: dict[str, list[str]] = {}
    waiting = {n.id: len(n.inputs) for n in nodes}
    for n in nodes:
        for i in n.inputs:
            dependents.setdefault(i, []).append(n.id)
    ready = deque(n.id for n in nodes if waiting[n.id] == 0)
    out = []
    while ready:
        out.append(now := ready.popleft())
        for d in dependents.get(now, ()):
            waiting[d] -= 1
            if waiting[d] == 0:
                ready.append(d)
    return out


def measure(plan: Plan, top: int = TOP) -> Metrics:
    """Nodes, input references, nodes on the longest path, and peaks of out- and in-degree."""
    by_id = {n.id: n for n in plan.nodes}
    outs = dict.fromkeys(by_id, 0)
    for n in plan.nodes:
        for i in n.inputs:
            if i in outs:
                outs[i] += 1
    ins = {n.id: len(n.inputs) for n in plan.nodes}
    depth: dict[str, int] = {}
    before: dict[str, str | None] = {}
    for x in order(plan.nodes):
        depth[x], before[x] = 1, None
        for i in by_id[x].inputs:
            if depth.get(i, 0) + 1 > depth[x]:
                depth[x], before[x] = depth[i] + 1, i
    path: list[str] = []
    at = max(depth, key=depth.get, default=None)
    while at is not None:
        path.append(at)
        at = before[at]
    largest = lambda of: tuple((x, by_id[x].op, d) for x, d in sorted(of.items(), key=lambda e: -e[1])[:top])
    return Metrics(len(plan.nodes), sum(ins.values()), len(path), max(outs.values(), default=0), max(ins.values(), default=0), largest(outs), largest(ins), tuple(reversed(path)))


def score(m: Metrics, w: Weights = Weights()) -> int:
    return int(w.node_count * m.node_count + w.max_depth * m.max_depth + w.fanout_peak * m.fanout_peak + w.fanin_peak * m.fanin_peak + w.edge_count * m.edge_count)


def check_budget(m: Metrics, budget: Budget = Budget()) -> Verdict:
    """Hard limits reject, soft limits warn; only what is above a limit does."""
    kinds = {"node_count": "hard", "edge_count": "soft", "max_depth": "hard", "fanout_peak": "hard", "fanin_peak": "hard"}
    limit = {k: getattr(budget, k) for k in kinds}
    over = {k: f"{k}={getattr(m, k)} ({kinds[k]}_limit={limit[k]})" for k in kinds if 0 < limit[k] < getattr(m, k)}
    violations = tuple(v for k, v in over.items() if kinds[k] == "hard")
    warnings = [v for k, v in over.items() if kinds[k] == "soft"]
    if 0 < budget.complexity_score < (s := score(m, budget.weights)):
        warnings.append(f"complexity_score={s} (soft_limit={budget.complexity_score})")
    if not violations:
        return Verdict(True, (), tuple(warnings))
    lines = ["PLAN_TOO_COMPLEX:"]
    lines += [f"  {k}={getattr(m, k)}" + (f" ({kinds[k]}_limit={limit[k]})" if limit[k] else "") for k in kinds]
    for what, rows in (("fanout", m.top_fanout), ("fanin", m.top_fanin)):
        if rows:
            lines.append(f"Top {what} nodes:")
            lines += [f"  {i} {op} {what}={d}" for i, op, d in rows if d > 0]
    if p := m.longest_path:
        shown = list(p) if len(p) <= SHOWN + 2 else [*p[:SHOWN], "...", p[-1]]
        lines += [f"Longest path (len={len(p)}):", "  " + " -> ".join(shown)]
    lines += ["Hint:", "  Move repeated logic into one to three module nodes, or ask for a core node."]
    return Verdict(False, violations, tuple(warnings), "\n".join(lines))
