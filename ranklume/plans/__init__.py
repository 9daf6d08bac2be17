"""Plans: parsing, checks, complexity, compilation and execution."""

from .compiler import CompiledPlan, CompileError, compile_plan
from .complexity import Budget, Metrics, check_budget, measure, score
from .executor import execute
from .pipeline import Pipeline
from .plan import Plan, PlanError, PlanNode, load_plan, parse_plan

__all__ = ["Budget", "CompileError", "CompiledPlan", "Metrics", "Pipeline", "Plan", "PlanError", "PlanNode", "check_budget", "compile_plan", "execute", "load_plan", "measure", "parse_plan", "score"]
