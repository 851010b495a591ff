"""Identifiers, names, lines and scores as Spark columns; all built-in expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _marked_letters() -> dict[str, str]:
    """Letters that are one base character and marks, with that character: Latin, Greek, Cyrillic and their extensions."""
    found = {}
    for code in (*range(0xC0, 0x590), *range(0x1E00, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all(unicodedata.category(m) == "Mn" for m in marks):
            found[chr(code)] = base
    return found


_MARKED = _marked_letters()


def without_marks(text: Column) -> Column:
    """Letters without accents and other marks, as full-text search compares them; quick where every code point is one byte."""
    plain = F.translate(text, "".join(_MARKED), "".join(_MARKED.values()))
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.regexp_replace(plain, r"\p{Mn}+", ""))


def normalize_identifier(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", ""))


def identifier_terms(text: Column) -> Column:
    """Lower-case runs of letters and digits; a capital after a small letter begins a new one."""
    spaced = F.regexp_replace(text, r"(?<=\p{Ll})(?=\p{Lu})", " ")
    return F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{Nd}]+"), lambda t: t != "")


def identifier_exact(name: Column, query: Column) -> Column:
    """Whether some terms in a row of the name make the normalised query."""
    terms = identifier_terms(name)
    n = F.size(terms)
    runs = lambda start: F.exists(
        F.sequence(F.lit(1), n - start + 1), lambda length: F.array_join(F.slice(terms, start, length), "") == query
    )
    possible = (query != "") & (n > 0) & F.contains(normalize_identifier(name), query)
    return F.when(possible, F.exists(F.sequence(F.lit(1), n), runs)).otherwise(False)


def all_terms_in(text: Column, terms: Column) -> Column:
    """Whether the text contains every term, whatever its case; false without terms. No pattern characters."""
    return (F.size(terms) > 0) & F.forall(terms, lambda t: F.contains(F.lower(text), t))


def same_text(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def match_line(content: Column, text: Column) -> Column:
    """The line of the first hit, whatever its case, counted in the lower-cased text; 1 if none."""
    lowered = F.lower(content)
    at = F.instr(lowered, F.lower(text))
    before = F.substring(lowered, F.lit(1), at - 1)
    lines = F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return F.when((text == "") | (at < 1), 1).otherwise(lines).cast("int")


def short_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def last_two(name: Column) -> Column:
    """The last two dotted parts of a name with three or more, else null: the key of suffix lookups."""
    dots = F.char_length(name) - F.char_length(F.replace(name, F.lit("."), F.lit("")))
    return F.when(dots >= 2, F.substring_index(name, ".", -2))


def signature_arity(signature: Column) -> Column:
    """The number of parameters; -1 without brackets. Commas inside <> and [] do not count."""
    inside = F.trim(F.regexp_extract(signature, r"^[^(]*\((.*)\)[^)]*$", 1))
    depth = F.aggregate(
        F.split(inside, ""),
        F.struct(F.lit(0).alias("depth"), F.lit(1).alias("n")),
        lambda acc, c: F.struct(
            (acc.depth + F.when(c.isin("<", "["), 1).when(c.isin(">", "]"), -1).otherwise(0)).alias("depth"),
            (acc.n + F.when((c == ",") & (acc.depth == 0), 1).otherwise(0)).alias("n"),
        ),
        lambda acc: acc.n,
    )
    return F.when(~signature.rlike(r"\(.*\)"), -1).when(inside == "", 0).otherwise(depth)


def module_prefix(path: Column) -> Column:
    """The module a file lies in: what is before /src/, else its folder; empty at the top."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")
    return (
        F.when(F.instr(path, "/src/") > 0, F.substring_index(path, "/src/", 1))
        .when(F.startswith(path, F.lit("src/")), F.lit(""))
        .otherwise(folder)
    )


def join_http_path(prefix: Column, path: Column) -> Column:
    """One path of two, with one slash between and one in front."""
    cut = lambda c: F.regexp_replace(c, r"^/+|/+$", "")
    return F.concat(F.lit("/"), F.array_join(F.filter(F.array(cut(prefix), cut(path)), lambda p: p != ""), "/"))


# Kinds by stage of a flow.
STAGES = {
    "entry": ["controller", "controller_method", "route"],
    "application": ["application", "application_method"],
    "repository": ["repository", "repository_method"],
    "mapper": ["mapper", "mapper_method", "mapper_statement", "maps_statement"],
    "table": ["queries_table", "migration_table"],
    "cross_service": ["contract_http", "contract_dubbo", "contract_mq"],
    "configuration": ["uses_config"],
}


def stage(kind: Column) -> Column:
    out = F.lit("domain_or_service")
    for name, kinds in STAGES.items():
        out = F.when(kind.isin(*kinds), name).otherwise(out)
    return out


# Scores of matches.
SYMBOL_SCORES = (1000.0, 900.0, 700.0)
EDGE_SCORES = (800.0, 750.0, 600.0)
FULL_TEXT_SCORE = 300.0
SUBSTRING_SCORE = 200.0


def name_score(name: Column, text: Column, query: Column, scores: tuple[float, float, float]) -> Column:
    return F.when(same_text(name, text), scores[0]).when(identifier_exact(name, query), scores[1]).otherwise(scores[2])


def full_text_score(rank: Column) -> Column:
    """300 and a share of one more, rising with -rank."""
    quality = F.greatest(-rank, F.lit(0.0))
    return FULL_TEXT_SCORE + quality / (60 + quality)


def keywords(text: Column) -> Column:
    """ASCII words of three characters or more, then all trigrams of Han runs (a run of two is one keyword)."""
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_/-]{2,})"), 1)
    runs = F.regexp_extract_all(text, F.lit(r"(\p{IsHan}+)"), 1)
    grams = F.transform(
        runs,
        lambda run: F.when(F.char_length(run) == 2, F.array(run))
        .when(
            F.char_length(run) > 2,
            F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(run) - 2, F.lit(1))), lambda i: F.substring(run, i, F.lit(3))),
        )
        .otherwise(F.array().cast("array<string>")),
    )
    return F.concat(words, F.flatten(grams))


def without_user_info(url: Column) -> Column:
    """A URL without name and password."""
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1")


# What is indexed.
SUPPORTED = ["java", "xml", "yml", "yaml", "properties", "sql", "md", "json", "ts", "tsx", "js", "vue", "html"]


def is_supported(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)pom\.xml$|\.(" + "|".join(SUPPORTED) + ")$")


# Rules of the sensitive-text scan: name and pattern.
SENSITIVE = {
    "credential": r"(?i)(password|passwd|secret|token|api[_-]?key)\s*[:=]\s*['\"]?[A-Za-z0-9_\-/+]{8,}",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "local_path": r"(/(home|Users)/[A-Za-z0-9._-]+/|[A-Za-z]:\\Users\\[A-Za-z0-9._-]+)",
    "address": r"(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}",
    "control": r"[\x00-\x08\x0B\x0C\x0E-\x1F]",
}


def sensitive_rules(text: Column) -> Column:
    """The names of the rules that the text breaks, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in SENSITIVE.items()]))
