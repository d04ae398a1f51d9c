"""Routing of the collection workflow, as a function and as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomgraph.functions.text import strip

STAGES = ("interpret", "approve", "extract_confirm")
AFTER_PROCEED = {"interpret": "expand_search", "approve": "gate", "extract_confirm": "extract"}


def next_step(stage: str, decision: str, strict_parity: bool = False) -> str:
    """Step that follows a decision. Revising re-parses; anything else at the interpret
    stage continues, except that cancelling is honoured there (`strict_parity` searches
    instead). Later stages continue only on proceed."""
    if stage not in AFTER_PROCEED:
        raise ValueError(f"unknown stage: {stage}")
    if stage == "interpret":
        if decision.startswith("revise:"):
            return "parse"
        return "report" if decision == "cancel" and not strict_parity else "expand_search"
    return AFTER_PROCEED[stage] if decision == "proceed" else "report"


def next_step_column(stage: Column, decision: Column, strict_parity: bool = False) -> Column:
    interpret = F.when(decision.startswith("revise:"), "parse")
    if not strict_parity:
        interpret = interpret.when(decision == "cancel", "report")
    later = F.when(decision == "proceed", F.when(stage == "approve", "gate").otherwise("extract"))
    return F.when(stage == "interpret", interpret.otherwise("expand_search")).otherwise(
        F.coalesce(later, F.lit("report"))
    )


REVISE = "revise:"


def revised_text(decision: str) -> str:
    """New command carried by a revise decision."""
    return decision.removeprefix(REVISE).strip()


def revised_query(decision: Column) -> Column:
    """`revised_text` of revise decisions, else null."""
    return F.when(decision.startswith(REVISE), strip(F.substr(decision, F.lit(len(REVISE) + 1))))
