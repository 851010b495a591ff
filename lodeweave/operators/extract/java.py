"""Java: one type a file, its methods, calls through fields, routes and service contracts.

The source is masked (comments and literals become blanks of the same length),
so that brackets and names are read off the mask while literals come from the
same offsets of the source. Members are found by walking the type's body at
depth one, statement by statement; nothing is bound that isn't certain.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .rows import Found, line_of

# Names the language knows.
PRIMITIVES = set("boolean byte char double float int long short void".split())
JAVA_LANG = set(
    "Boolean Byte Character Class Double Enum Error Exception Float Integer Iterable Long Math Number Object Override Runnable "
    "RuntimeException Short String StringBuilder System Thread Throwable Void".split()
)
MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": ""}
# What listens, what publishes, and the names that calls may have as receivers without being a gap.
LISTENERS = {"KafkaListener": ("topics", "kafka"), "RabbitListener": ("queues", "rabbit"), "RocketMQMessageListener": ("topic", "rocketmq")}
TEMPLATES = {"KafkaTemplate": "kafka", "RabbitTemplate": "rabbit", "RocketMQTemplate": "rocketmq"}
SENDS = {"send", "convertAndSend", "syncSend", "asyncSend"}
LISTENED = re.compile(r"@(?:Kafka|RocketMQ|Rabbit|RocketMQMessage)Listener$")
TOPIC_KEYS = ("topics", "topic", "value")
PUBLISHES = re.compile(r"\b(?:send|convertAndSend|syncSend)\s*\(")
IGNORED_RECEIVERS = {"this", "super", "log", "logger", "System", "Objects", "String", "Collections", "Optional", "Math", "Arrays"}
_MASK = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'", re.S)
_TYPE = re.compile(r"\b(class|interface|enum|record)\s+(\w+)")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_CALL = re.compile(r"(?<![\w.])([A-Za-z_]\w*)\s*\.\s*([A-Za-z_]\w*)\s*\(")
_LOCAL = re.compile(r"\b(?:final\s+)?(?:[A-Z]\w*(?:\s*<[^;=(){}]*>)?(?:\[\])*|int|long|boolean|double|float|char|byte|short|var)\s+(\w+)\s*(?=[=;:,)])")
_IMPORT = re.compile(r"^[ \t]*import\s+([\w.]+)\s*;", re.M)
_DYNAMIC = ("Class.forName(", "Proxy.", "${")
_BLANK = re.compile(r"\s*")
_STRING = re.compile(r"\s*\"([^\"]+)\"")
_VALUE = re.compile(r"^\s*\"\$\{([^}:]+)")


def mask(text: str) -> str:
    """The text with comments and literals blanked out; lines and offsets stay."""
    return _MASK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def closing(masked: str, at: int) -> int:
    """The offset of the bracket that closes the one at `at`, or -1."""
    pairs = {"(": ")", "{": "}", "[": "]"}
    stack = []
    for i in range(at, len(masked)):
        c = masked[i]
        if c in pairs:
            stack.append(pairs[c])
        elif c in ")}]":
            if not stack or stack.pop() != c:
                return -1
            if not stack:
                return i
    return -1


def split_top(text: str, masked: str | None = None) -> list[str]:
    """Parts between commas that no bracket encloses."""
    masked = mask(text) if masked is None else masked
    parts, depth, start = [], 0, 0
    for i, c in enumerate(masked):
        if c in "(<[{":
            depth += 1
        elif c in ")>]}":
            depth -= 1
        elif c == "," and not depth:
            parts.append(text[start:i])
            start = i + 1
    parts.append(text[start:])
    return [p.strip() for p in parts if p.strip()]


@dataclass
class Annotation:
    name: str
    at: int
    raw: str
    values: dict[str, list[str] | None]

    def literals(self, *keys: str) -> list[str] | None:
        """The literal values of the first key that is given; None if they aren't literal."""
        for key in keys:
            if key in self.values:
                return self.values[key]
        return []


def _literals(text: str) -> list[str] | None:
    text = text.strip()
    parts = split_top(text[1:-1]) if text.startswith("{") and text.endswith("}") else [text]
    found = [re.fullmatch(r"\"((?:[^\"\\]|\\.)*+)\"", p) for p in parts]
    return [m[1] for m in found] if all(found) else None


def annotations(text: str, masked: str, start: int, end: int) -> tuple[list[Annotation], str]:
    """The annotations between two offsets, and the masked rest without them."""
    found, rest, at = [], [], start
    for m in re.compile(r"@\s*([A-Za-z_][\w.]*)").finditer(masked, start, end):
        if m.start() < at or m[1] == "interface":
            continue
        rest.append(masked[at : m.start()])
        at = m.end()
        opened = re.compile(r"\s*\(").match(masked, at)
        values, raw = {}, ""
        if opened:
            close = closing(masked, opened.end() - 1)
            if close < 0:
                continue
            raw = text[opened.end() : close]
            for part in split_top(raw, masked[opened.end() : close]):
                key = re.match(r"(\w+)\s*=(?!=)\s*", part)
                values[key[1] if key else "value"] = _literals(part[key.end() :] if key else part)
            at = close + 1
        found.append(Annotation(m[1].rpartition(".")[2], m.start(), raw, values))
    rest.append(masked[at:end])
    return found, " ".join(rest)


@dataclass
class Method:
    name: str
    types: list[str]
    params: set[str]
    marks: list[Annotation]
    at: int
    body: tuple[int, int] | None
    end: int
    signature: str = ""
    symbol: str = ""


@dataclass
class JavaType:
    package: str = ""
    name: str = ""
    form: str = "class"
    imports: dict[str, str] = field(default_factory=dict)
    marks: list[Annotation] = field(default_factory=list)
    parents: list[str] = field(default_factory=list)
    interfaces: list[str] = field(default_factory=list)
    fields: dict[str, tuple[str, list[Annotation], int]] = field(default_factory=dict)
    methods: list[Method] = field(default_factory=list)

    @property
    def full(self) -> str:
        return f"{self.package}.{self.name}" if self.package else self.name

    def qualify(self, name: str) -> str:
        """The full name of a type without its parameters; array marks stay."""
        base = re.sub(r"<.*>", "", name, flags=re.S).replace(" ", "")
        stem = base.rstrip("[]")
        tail = base[len(stem) :]
        if "." in stem or stem in PRIMITIVES or len(stem) == 1 and stem.isupper():
            return stem + tail
        if stem in self.imports:
            return self.imports[stem] + tail
        if stem in JAVA_LANG:
            return f"java.lang.{stem}{tail}"
        return f"{self.package}.{stem}{tail}" if self.package else stem + tail


def _parameters(text: str, masked: str, start: int, end: int) -> tuple[list[str], set[str]] | None:
    types, names = [], set()
    raw, blank = text[start:end], masked[start:end]
    for part in split_top(raw, blank):
        offset = text.find(part, start)
        _, rest = annotations(text, masked, offset, offset + len(part))
        rest = re.sub(r"\bfinal\b", " ", rest).replace("...", "[] ").strip()
        m = re.fullmatch(r"([\w.]+(?:\s*<.*>)?(?:\s*\[\s*\])*)\s+(\w+)((?:\s*\[\s*\])*)", rest, re.S)
        if not m:
            return None
        types.append(re.sub(r"\s+", "", m[1] + m[3]))
        names.add(m[2])
    return types, names


def parse(text: str, found: Found) -> JavaType | None:
    masked = mask(text)
    head = _TYPE.search(masked)
    if not head:
        return None
    java = JavaType(name=head[2], form=head[1])
    m = re.search(r"^\s*package\s+([\w.]+)\s*;", masked, re.M)
    java.package = m[1] if m else ""
    before = m.end() if m else 0
    for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+)(?:\.\*)?\s*;", masked, re.M):
        java.imports[m[1].rpartition(".")[2]] = m[1]
        before = max(before, m.end())
    java.marks, _ = annotations(text, masked, min(before, head.start()), head.start())
    opened = masked.find("{", head.end())
    if opened < 0:
        return java
    parents = re.search(r"\b(?:extends|implements)\b(.*)", masked[head.end() : opened], re.S)
    if parents:
        java.parents = [p for p in split_top(re.sub(r"\b(?:extends|implements)\b", ",", parents[1])) if p]
        given = parents[0].partition("implements")[2]
        java.interfaces = [p for p in split_top(given) if p]
    close = closing(masked, opened)
    _members(text, masked, opened + 1, close if close >= 0 else len(masked), java, found)
    return java


def _members(text: str, masked: str, start: int, end: int, java: JavaType, found: Found) -> None:
    """Statements at depth one: fields end with `;`, methods have brackets before a body or `;`."""
    at = start
    while at < end:
        i, stop = at, None
        while i < end:
            c = masked[i]
            if c in "([":
                shut = closing(masked, i)
                if shut < 0:
                    return
                i = shut
            elif c in ";{":
                stop = i
                break
            elif c == "=":
                semicolon = i
                while semicolon < end and masked[semicolon] != ";":
                    semicolon = (closing(masked, semicolon) if masked[semicolon] in "({[" else semicolon) + 1
                    if semicolon <= 0:
                        return
                stop = semicolon
                break
            i += 1
        if stop is None:
            return
        body = None
        after = stop + 1
        if stop < end and masked[stop] == "{":
            shut = closing(masked, stop)
            if shut < 0:
                return
            body, after = (stop + 1, shut), shut + 1
        _member(text, masked, at, i, stop, body, after, java, found)
        at = after


def _member(text, masked, start, cut, stop, body, after, java: JavaType, found: Found) -> None:
    marks, rest = annotations(text, masked, start, cut)
    if _TYPE.search(rest):
        return
    plain_start = cut if not rest.strip() else start
    opened = -1
    depth_marks = [(a.at, a) for a in marks]
    for m in re.finditer(r"(\w+)\s*\(", masked[start:cut]):
        before = masked[start : start + m.start()].rstrip()
        if not before.endswith("@") and not any(a <= start + m.start() <= a + len(x.name) + len(x.raw) + 3 for a, x in depth_marks):
            opened = start + m.end() - 1
            break
    if opened >= 0 and cut == stop:
        name = re.search(r"(\w+)\s*$", masked[start:opened])[1]
        shut = closing(masked, opened)
        place = opened - len(name)
        if name == java.name:
            return
        read = _parameters(text, masked, opened + 1, shut)
        if read is None:
            found.diagnostic("unparsable_parameters", line_of(text, place))
            return
        types = [java.qualify(t) for t in read[0]]
        method = Method(name, types, read[1], marks, place, body, after - 1)
        method.symbol = f"{java.full}.{name}"
        method.signature = f"{java.name}.{name}({','.join(types)})"
        java.methods.append(method)
        return
    m = re.search(r"([\w.]+(?:\s*<.*>)?(?:\s*\[\s*\])*)\s+(\w+)\s*(?:=|$)", re.sub(r"\b(?:private|protected|public|static|final|transient|volatile)\b", " ", rest).strip() + " ", re.S)
    if m and body is None and m[1] not in ("return", "package", "import"):
        java.fields[m[2]] = (re.sub(r"\s+", "", m[1]), marks, plain_start)


def _component(java: JavaType) -> str:
    names = {m.name for m in java.marks}
    if names & {"RestController", "Controller"}:
        return "controller"
    if "Mapper" in names or java.name.endswith("Mapper") and java.form == "interface":
        return "mapper"
    if "Repository" in names:
        return "repository"
    if "Service" in names:
        return "application" if java.name.endswith("Application") else "service"
    return "class"


def _join(prefix: str, path: str) -> str:
    return "/" + "/".join(p for p in (prefix.strip("/"), path.strip("/")) if p)


def _routes(marks: list[Annotation], java: JavaType, found: Found, text: str, code: str) -> list[tuple[str, str]]:
    """(verb, path) of mapping annotations; a path that isn't literal is a diagnostic and no route."""
    out = []
    for mark in marks:
        if mark.name not in MAPPINGS:
            continue
        paths = mark.literals("value", "path")
        if paths is None:
            found.diagnostic(code, line_of(text, mark.at))
            continue
        verbs = re.findall(r"RequestMethod\.(\w+)", mark.raw)
        verb = MAPPINGS[mark.name] or (verbs[0] if len(verbs) == 1 else "ANY")
        out += [(verb, p) for p in paths or [""]]
    return out


def extract(text: str) -> Found:
    found = Found()
    java = parse(text, found)
    if java is None:
        return found
    masked, full, kind = mask(text), java.full, _component(java)
    line = lambda at: line_of(text, at)
    top = line(_TYPE.search(masked).start())
    found.symbol(full, kind, top, end_line=line(len(text)))
    for m in _IMPORT.finditer(masked):
        found.edge(full, m[1], "imports", line(m.start(1)))
    # `extends A implements B` gives a relation to each, on purpose: one target with both names could be bound to neither.
    for parent in java.parents:
        found.edge(full, parent.partition("<")[0].strip(), "implements", top, "probable")
    if any(sign in text for sign in _DYNAMIC):
        found.diagnostic("dynamic_behaviour", 1)
    for m in PUBLISHES.finditer(masked):
        topic = _STRING.match(text, m.end())
        if topic:
            found.edge(full, f"mq:{topic[1]}", "publishes_topic", line(m.start()))
    for mark in java.marks:
        if mark.name == "ConfigurationProperties":
            for prefix in mark.literals("value", "prefix") or []:
                found.edge(full, f"config:{prefix}", "uses_config", line(mark.at))
    for name, (type_name, marks, at) in java.fields.items():
        short = re.sub(r"<.*>|\[\]", "", type_name)
        place = line(_BLANK.match(masked, at).end())
        if short[:1].isupper():
            found.edge(full, short, "uses", place, "probable")
        for mark in marks:
            if mark.name == "DubboReference":
                found.edge(full, f"dubbo:{short.rpartition('.')[2]}", "dubbo_reference", line(mark.at))
                if any(mark.literals(k) not in ([], [""]) for k in ("group", "version")):
                    found.diagnostic("dubbo_qualifier", line(mark.at))
                else:
                    found.contract("dubbo", "consumer", java.qualify(short), full, line(mark.at), reason="@DubboReference")
            if mark.name == "Value":
                key = _VALUE.match(mark.raw)
                if key:
                    found.edge(full, f"config:{key[1].strip()}", "uses_config", line(mark.at))
    _type_contracts(java, found, text)
    feign = next((m for m in java.marks if m.name == "FeignClient"), None)
    service = _feign(feign, found, text) if feign else None
    if feign and len(named := feign.literals("name", "value") or []) == 1:
        found.edge(full, f"feign:{named[0]}", "feign_client", line(feign.at))
    prefixes = [p for _, p in _routes(java.marks, java, found, text, "dynamic_http_path_of_class")] or [""]
    for method in java.methods:
        _method(method, java, kind, prefixes, service if feign else None, bool(feign), found, text, masked)
    return found


def _type_contracts(java: JavaType, found: Found, text: str) -> None:
    service = next((m for m in java.marks if m.name == "DubboService"), None)
    if service is None:
        return
    top = line_of(text, _TYPE.search(mask(text)).start())
    found.edge(java.full, f"dubbo:{java.name}", "dubbo_service", top)
    if any(service.literals(k) not in ([], [""]) for k in ("group", "version")):
        found.diagnostic("dubbo_qualifier", top)
        return
    for parent in java.interfaces:
        found.contract("dubbo", "provider", java.qualify(parent), java.full, top, reason="@DubboService implements interface")


def _feign(mark: Annotation, found: Found, text: str) -> tuple[str, str] | None:
    """(service, path) of a client whose metadata is literal and has no url."""
    names, paths = mark.literals("name", "value"), mark.literals("path")
    if "url" in mark.values or not names or len(names) != 1 or paths is None or "${" in names[0]:
        found.diagnostic("unsafe_feign_metadata", line_of(text, mark.at))
        return None
    return names[0], (paths or [""])[0]


def _method(method: Method, java: JavaType, kind: str, prefixes, service, is_feign: bool, found: Found, text: str, masked: str) -> None:
    at = line_of(text, method.at)
    kinds = {"class": "class_method"}
    found.symbol(method.symbol, kinds.get(kind, f"{kind}_method"), at, method.signature, line_of(text, method.end))
    routes = _routes(method.marks, java, found, text, "dynamic_http_path_of_method")
    for verb, path in routes:
        for prefix in prefixes:
            whole = _join(prefix, path)
            if kind == "controller":
                found.edge(method.symbol, whole, "route", at, signature=method.signature)
                found.contract("http", "provider", f"{verb}:{whole}", method.symbol, at, signature=method.signature)
            elif is_feign and service is not None:
                found.contract("http", "consumer", f"{verb}:{_join(service[1], whole)}", method.symbol, at, service=service[0], signature=method.signature)
    for mark in method.marks:
        if mark.name == "Scheduled":
            found.edge(java.full, f"schedule:{java.name}#{method.name}", "scheduled_job", line_of(text, mark.at))
        if LISTENED.match(f"@{mark.name}"):
            # Only a named, single literal topic is a relation; the contracts below have the lists, too.
            for key in TOPIC_KEYS:
                if re.search(rf"\b{key}\s*=", mark.raw) and len(topics := mark.literals(key) or []) == 1:
                    found.edge(java.full, f"mq:{topics[0]}", "consumes_topic", line_of(text, mark.at))
        if mark.name in LISTENERS:
            key, broker = LISTENERS[mark.name]
            for topic in mark.literals(key, *TOPIC_KEYS) or []:
                found.contract("mq", "consumer", topic, method.symbol, at, broker=broker, signature=method.signature, reason="message listener literal topic")
    if method.body:
        _calls(method, java, found, text, masked)


def _calls(method: Method, java: JavaType, found: Found, text: str, masked: str) -> None:
    start, end = method.body
    for m in _CALL.finditer(masked, start, end):
        receiver, name, at = m[1], m[2], line_of(text, m.start())
        shut = closing(masked, m.end() - 1)
        if shut < 0 or shut > end:
            continue
        owned = java.fields.get(receiver)
        if owned is None:
            if receiver not in IGNORED_RECEIVERS and receiver not in method.params and not receiver[0].isupper():
                found.diagnostic("unbound_receiver", at)
            continue
        hidden = receiver in method.params or any(x[1] == receiver for x in _LOCAL.finditer(masked, start, m.start()))
        if hidden:
            found.diagnostic("shadowed_field_call", at)
            continue
        stem = re.sub(r"<.*>", "", owned[0])
        arguments = split_top(text[m.end() : shut], masked[m.end() : shut].replace("<", " ").replace(">", " "))
        if stem in TEMPLATES and name in SENDS:
            literal = _literals(arguments[0]) if arguments else None
            if literal:
                _publish(method, stem, literal[0], at, found)
        found.edge(method.symbol, f"{java.qualify(stem)}.{name}", "calls", at, signature=method.signature, arity=len(arguments))


def _publish(method: Method, template: str, topic: str, at: int, found: Found) -> None:
    if template == "RabbitTemplate":
        found.diagnostic("rabbit_publish_ambiguous", at)
    elif template == "RocketMQTemplate" and ":" in topic:
        found.diagnostic("rocketmq_tag", at)
    else:
        found.contract("mq", "provider", topic, method.symbol, at, broker=TEMPLATES[template], signature=method.signature, reason="message publish literal topic")
