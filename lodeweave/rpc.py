"""The operations as tools of a JSON-RPC 2.0 service: one message a line, no reply to notifications."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import IO, Any

PROTOCOL = "2025-03-26"
INVALID = -32602

_TEXT, _LIMIT = {"type": "string"}, {"type": "integer", "minimum": 1}
_GRAPH = {"text": _TEXT, "repository": _TEXT, "limit": _LIMIT | {"maximum": 200}, "max_depth": _LIMIT | {"maximum": 32}}
_SEARCH = {"text": _TEXT, "repository": _TEXT, "limit": _LIMIT | {"maximum": 1000}}
# Every tool with what it is for and the arguments that it takes.
# Names, purposes and arguments of the public operations.
TOOLS: dict[str, tuple[str, dict]] = {
    "workspace_status": ("Repositories with their files and diagnostics", {}),
    "find_business_context": ("Ranked evidence for a text, and how complete it is", _SEARCH),
    "get_evidence": ("Ranked evidence for a keyword, and how complete it is", _SEARCH),
    "trace_code_path": ("Paths from a symbol", _GRAPH),
    "analyze_change_impact": ("Relations that lead to a symbol", _GRAPH),
    "trace_business_flow": ("Stages from an entry, across services", _GRAPH),
    "get_symbol_context": ("Callers, callees, flow and contracts of a symbol", _GRAPH | {"view": {"type": "string", "enum": ["summary", "detail"]}}),
    "list_contracts": ("Service contracts and their links", _GRAPH),
    "analyze_change": ("Evidence in the files of a commit or range", {"range": _TEXT}),
    "analyze_requirement": ("Where a requirement is likely to be met", {"text": _TEXT}),
    "analyze_inputs": ("A report on texts and documents", {"text": _TEXT, "paths": {"type": "array", "items": _TEXT}, "source_ref": _TEXT}),
    "get_analysis_report": ("A stored report", {"id": _TEXT}),
    "record_analysis_feedback": ("Confirms or rejects what a report says", {k: _TEXT for k in ("report_id", "subject_kind", "subject_key", "decision", "note")}),
}
WRITES = {"record_analysis_feedback"}
# Arguments that the operations know by another name.
RENAMED = {
    **{name: {"text": "target"} for name in ("trace_code_path", "analyze_change_impact", "trace_business_flow", "get_symbol_context")},
    "get_analysis_report": {"id": "report_id"},
}


def tools() -> list[dict]:
    pinned = {"freshness": {"type": "string", "enum": ["stable", "latest"]}, "snapshot_id": _TEXT}
    out = []
    for name, (purpose, arguments) in TOOLS.items():
        schema: dict[str, Any] = {"type": "object", "properties": arguments if name in WRITES else arguments | pinned, "additionalProperties": False}
        if name in WRITES:
            schema["required"] = list(arguments)
        out.append({"name": name, "description": purpose, "inputSchema": schema, "annotations": {"readOnlyHint": name not in WRITES}})
    return out


def _answer(session, method: str, given: dict) -> dict:
    if method == "initialize":
        return {"protocolVersion": PROTOCOL, "serverInfo": {"name": "lodeweave", "version": "1"}, "capabilities": {"tools": {}}}
    if method == "tools/list":
        return {"tools": tools()}
    if method != "tools/call":
        raise ValueError(f"unknown method: {method}")
    name = given.get("name", "")
    if name not in TOOLS:
        raise ValueError(f"unknown tool: {name}")
    renamed = RENAMED.get(name, {})
    arguments = {renamed.get(key, key): value for key, value in (given.get("arguments") or {}).items()}
    return {"content": [{"type": "text", "text": json.dumps(session.call(name, arguments), default=str)}]}


def serve(session, messages: Iterable[str], out: IO[str]) -> None:
    """Answers each message in turn; what a message asks wrongly is an error of that message only."""
    for line in messages:
        if not line.strip():
            continue
        message = json.loads(line)
        if message.get("method", "").startswith("notifications/"):
            continue
        reply: dict[str, Any] = {"jsonrpc": "2.0", "id": message.get("id")}
        try:
            reply["result"] = _answer(session, message.get("method", ""), message.get("params") or {})
        except Exception as problem:
            reply["error"] = {"code": INVALID, "message": str(problem)}
        out.write(json.dumps(reply) + "\n")
        out.flush()
