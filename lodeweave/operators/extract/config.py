"""Configuration, SQL, front-end calls and API descriptions."""

from __future__ import annotations

import os
import re

from .lines import RULES
from .rows import Found, line_of

# Configuration keys, in lower case, that name a service or a broker.
SERVICE_KEY = "spring.application.name"
BROKER_KEYS = {
    "spring.kafka.bootstrap-servers": "kafka",
    "spring.kafka.bootstrapservers": "kafka",
    "spring.rabbitmq.host": "rabbit",
    "spring.rabbitmq.addresses": "rabbit",
    "rocketmq.name-server": "rocketmq",
    "rocketmq.nameserver": "rocketmq",
}
_NESTED = re.compile(r"([ \t]*)([^:\n]+?)[ \t]*:(.*)")


def _value(raw: str) -> str:
    return raw.split(" #", 1)[0].strip().strip("\"'")


def settings(text: str) -> list[tuple[str, str, int]]:
    """(dotted key, value, line): a line with `=` is a pair of its own, others nest by their indentation."""
    found: list[tuple[str, str, int]] = []
    above: dict[int, str] = {}
    for number, line in enumerate(text.replace("\r\n", "\n").split("\n"), 1):
        plain = line.strip()
        if plain[:1] in ("", "#"):
            continue
        if "=" in plain[1:]:
            key, _, value = plain.partition("=")
            found.append((key.strip(), _value(value), number))
        elif m := _NESTED.match(line):
            depth = len(m[1])
            above = {d: k for d, k in above.items() if d < depth}
            key = m[2].strip().strip("\"'")
            if m[3].strip():
                found.append((".".join([*above.values(), key]), _value(m[3]), number))
            else:
                above[depth] = key
    return found


def _contracts(path: str, text: str, found: Found) -> None:
    """Services and brokers that literal settings name; any other dynamic setting is a gap."""
    symbol = f"config:{path}"
    for key, value, line in settings(text):
        broker = BROKER_KEYS.get(key.lower())
        if "${" in value or "#{" in value:
            found.diagnostic("dynamic_config", line)
        elif broker:
            found.contract("broker", "provider", broker, symbol, line, broker=f"{broker}:{''.join(value.split())}", reason="message broker configuration")
        elif key.lower() == SERVICE_KEY:
            found.contract("service", "provider", value, symbol, line, service=value, reason=SERVICE_KEY)


def extract(path: str, text: str) -> Found:
    found = Found()
    suffix, source = os.path.splitext(path)[1].lower(), os.path.basename(path)
    for rule in RULES.values():
        if suffix in rule.suffixes:
            for target, at in rule.found(text):
                found.edge(source, target, rule.kind, line_of(text, at))
    if suffix in RULES["defines_config"].suffixes:
        _contracts(path, text, found)
    if "${" in text:
        found.diagnostic("dynamic_marker", 1)
    return found
