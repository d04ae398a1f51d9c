"""Graph commands: the typed requests a translator produces, and what each one selects."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame

from loomgraph.operators import lineage as G, view


@dataclass
class FilterRequest:
    ptype: str | None = None
    domain: str | None = None
    date_after: str | None = None

    def parts(self) -> dict[str, str]:
        named = {"ptype": self.ptype, "domain": self.domain, "date_after": self.date_after}
        return {k: v for k, v in named.items() if v}

    def summary(self) -> str:
        shown = [f"from {v}" if k == "date_after" else v for k, v in self.parts().items()]
        return " · ".join(shown) or "all"

    def chips(self) -> list[str]:
        return [f"{k}={v}" for k, v in self.parts().items()]


@dataclass
class LineageRequest:
    node: str
    direction: str = "both"


@dataclass
class ResetRequest:
    pass


@dataclass
class CollectRequest:
    topic_text: str


Request = FilterRequest | LineageRequest | ResetRequest | CollectRequest


class Translator(Protocol):
    """Natural language to a tool call {tool, args}, or {tool: None, message}."""

    def translate(self, text: str, names: DataFrame) -> dict: ...


@dataclass
class CommandResult:
    """`ids` is the selection (None = everything); `changed` is False when the command
    leaves the current selection as it was."""

    message: str
    changed: bool = False
    ids: DataFrame | None = None
    edges: DataFrame | None = None
    chips: list[str] = field(default_factory=list)


def to_request(call: dict) -> Request | None:
    """The request a tool call stands for; None for an unknown tool."""
    args = call.get("args") or {}
    tool = call.get("tool")
    if tool == "filter":
        return FilterRequest(args.get("ptype"), args.get("domain"), args.get("date_after"))
    if tool == "focus_lineage":
        return LineageRequest(args.get("node") or "", args.get("direction") or "both")
    if tool == "reset":
        return ResetRequest()
    if tool == "collect":
        return CollectRequest(args.get("topic_text") or "")
    return None


def checked_call(call: dict, nodes: DataFrame, strict_lower: bool = False) -> dict:
    """A tool call after the server's checks: messages are cut to 200 characters and a
    lineage request must name an existing node."""
    if not call.get("tool"):
        return {"tool": None, "message": (call.get("message") or "")[:200]}
    request = to_request(call)
    if isinstance(request, LineageRequest) and G.find_node(nodes, request.node, strict_lower) is None:
        return {"tool": None, "message": f"no node named '{request.node}'"}
    return {"tool": call["tool"], "args": call.get("args") or {}}


def run(request: Request, nodes: DataFrame, edges: DataFrame) -> CommandResult:
    """Executes a filter, lineage or reset request over the concept view."""
    if isinstance(request, ResetRequest):
        return CommandResult("showing everything", changed=True)
    if isinstance(request, FilterRequest):
        picked = view.filter_nodes(nodes, request.ptype, request.domain, request.date_after)
        ids = picked.select("id")
        n = ids.count()
        if n == 0:
            return CommandResult("no node matches")
        return CommandResult(f"{request.summary()} · {n} nodes", True, ids,
                             view.induced_edges(edges, ids), request.chips())
    if isinstance(request, LineageRequest):
        found = G.lineage(edges, nodes, request.node, request.direction)
        if found is None:
            return CommandResult(f"no node named '{request.node}'")
        label = nodes.filter(nodes["id"] == found.key).first()["canonical"]
        return CommandResult(
            f"lineage of '{label}' (ancestors {found.ancestors} · descendants {found.descendants})",
            True, found.ids, view.induced_edges(edges, found.ids), [f"lineage={label}"],
        )
    return CommandResult("unknown tool")
