"""Extractors that one pattern covers, as Spark expressions: no Python workers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import RULES, Rule


def maven_modules(files: DataFrame) -> DataFrame:
    """(repository_id, path, source, target, kind): the first artifact is the module, the later ones what it depends on."""
    names = F.regexp_extract_all("content", F.lit(r"(?is)<artifactId>\s*([^<\s]+)\s*</artifactId>"), 1)
    rows = files.filter(F.lower("path").rlike(r"(^|/)pom\.xml$")).select("repository_id", "path", names.alias("names")).filter(F.size("names") > 0)
    rows = rows.select("repository_id", "path", F.col("names")[0].alias("own"), F.posexplode("names").alias("no", "name"))
    is_own = F.col("no") == 0
    return rows.select(
        "repository_id", "path", F.when(~is_own, F.concat(F.lit("maven:"), "own")).alias("source"), F.concat(F.lit("maven:"), "name").alias("target"),
        F.when(is_own, "maven_module").otherwise("depends_on_module").alias("kind"),
    )


def _target(rule: Rule) -> Column:
    """The rule's target of a whole match, group by group."""
    parts = []
    for text, name in re.findall(r"([^{]*)\{(\w+)\}", rule.target):
        group = F.regexp_extract("match", rule.pattern, 1 if name == "verb" else int(name) + 1)
        parts += [F.lit(text), F.upper(group) if name == "verb" else group]
    return F.concat(*parts)


def line_relations(files: DataFrame, kind: str) -> DataFrame:
    """(repository_id, path, source, target, kind) of the rule of that kind."""
    rule = RULES[kind]
    found = F.regexp_extract_all("content", F.lit(rule.pattern), 0)
    rows = files.filter(F.lower("path").rlike(rule.files)).select("repository_id", "path", F.explode(found).alias("match"))
    return rows.select("repository_id", "path", F.substring_index("path", "/", -1).alias("source"), _target(rule).alias("target"), F.lit(kind).alias("kind"))
