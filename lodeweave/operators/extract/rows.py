"""What extraction finds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass
class Found:
    symbols: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    contracts: list[dict] = field(default_factory=list)
    diagnostics: list[dict] = field(default_factory=list)

    def symbol(self, name: str, kind: str, line: int, signature: str = "", end_line: int = 0) -> None:
        self.symbols.append({"name": name, "kind": kind, "line": line, "signature": signature, "end_line": end_line})

    def edge(self, source: str, target: str, kind: str, line: int, confidence: str = "certain", signature: str = "", arity: int | None = None) -> None:
        self.edges.append({"source": source, "target": target, "kind": kind, "line": line, "confidence": confidence, "source_signature": signature, "target_arity": arity})

    def contract(self, kind: str, role: str, key: str, symbol: str, line: int, service: str = "", signature: str = "", broker: str = "", reason: str = "") -> None:
        self.contracts.append({"kind": kind, "role": role, "target": key, "symbol": symbol, "line": line, "service": service, "signature": signature, "broker": broker, "reason": reason, "confidence": "certain"})

    def diagnostic(self, code: str, line: int) -> None:
        self.diagnostics.append({"reason": code, "line": line, "confidence": "unresolved"})

    def rows(self) -> Iterator[dict]:
        for table, items in (("symbol", self.symbols), ("edge", self.edges), ("contract", self.contracts), ("diagnostic", self.diagnostics)):
            for item in items:
                yield {"table": table} | item


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1
