"""Relations that one pattern a file kind finds: kept once, for the extractor in partitions and for Spark expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """suffixes: file kinds; pattern: read by Python and by Java alike, so word bounds are spelt out; target: of its groups."""

    kind: str
    suffixes: tuple[str, ...]
    pattern: str
    target: str

    @property
    def files(self) -> str:
        return rf"\.({'|'.join(s[1:] for s in self.suffixes)})$"

    def found(self, text: str) -> list[tuple[str, int]]:
        """(target, offset) of each match."""
        return [(self.target.format(*m.groups(), verb=m[1].upper()), m.start(1)) for m in re.finditer(self.pattern, text)]


# What names a configuration key, a migrated table, a call of a path and a described path. `if exists`
# before a table's name is skipped on purpose: otherwise `if` would be taken for the table. Only blanks and tabs are
# skipped before a key, so that its line is its own on purpose, not that of an empty line above it.
RULES = {
    "defines_config": Rule("defines_config", (".yml", ".yaml", ".properties"), r"(?m)^[ \t]*([A-Za-z][A-Za-z0-9_.-]+)[ \t]*[=:]", "config:{0}"),
    "migration_table": Rule(
        "migration_table",
        (".sql",),
        r"(?i)(?<![A-Za-z0-9_])(?:create|alter|drop|insert\s+into|update)\s+(?:table\s+)?(?:if\s+(?:not\s+)?exists\s+)?[`\"]?([A-Za-z0-9_]+)",
        "table:{0}",
    ),
    "calls_http": Rule(
        "calls_http", (".ts", ".tsx", ".js", ".vue", ".html"), r"(?i)(?<![A-Za-z0-9_])(get|post|put|delete|patch)\s*\(\s*['\"](/[^'\"]+)", "http:{verb}:{1}"
    ),
    "api_contract": Rule("api_contract", (".json", ".yml", ".yaml"), r"(?m)^[ \t]*['\"]?(/[^'\"\s:]+)['\"]?[ \t]*:", "http:ANY:{0}"),
}
