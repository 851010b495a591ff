"""Maven files and mapper XML."""

from __future__ import annotations

import re

from .rows import Found, line_of

_ARTIFACT = re.compile(r"<artifactId>\s*([^<\s]+)\s*</artifactId>", re.I)
_MAPPER = re.compile(r"<mapper\s[^>]*?namespace\s*=\s*\"([^\"]+)\"", re.I)
_STATEMENT = re.compile(r"<(select|insert|update|delete)\s(?:[^>]*?\s)?id\s*=\s*\"([^\"]+)\"", re.I)
_TABLE = re.compile(r"\b(?:from|join|update|into)\s+[`\"]?([A-Za-z0-9_]+)", re.I)


def maven(text: str) -> Found:
    """The first artifact is the module, the others are what it depends on."""
    found, module = Found(), None
    for m in _ARTIFACT.finditer(text):
        name, line = f"maven:{m[1]}", line_of(text, m.start())
        if module is None:
            module = name
            found.symbol(name, "maven_module", line)
        else:
            found.edge(module, name, "depends_on_module", line)
    return found


def mapper(text: str) -> Found:
    found = Found()
    space = _MAPPER.search(text)
    if not space:
        found.diagnostic("mapper_without_namespace", 1)
        return found
    if "${" in text or "<if" in text.lower():
        found.diagnostic("dynamic_sql", 1)
    found.symbol(space[1], "mapper", 1)
    for m in _STATEMENT.finditer(text):
        name, line = f"{space[1]}.{m[2]}", line_of(text, m.start())
        found.symbol(name, "mapper_statement", line)
        found.edge(space[1], name, "maps_statement", line)
        # A statement that nothing closes has no body to read tables from.
        close = re.compile(f"</{m[1]}\\s*>", re.I).search(text, m.end())
        if close:
            for table in _TABLE.finditer(text, m.end(), close.start()):
                found.edge(name, table[1], "queries_table", line_of(text, table.start()))
    return found
