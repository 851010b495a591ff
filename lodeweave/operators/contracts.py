"""Service contracts: consumers linked to providers, only where one provider is certain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as fn
from ..schemas import symbol_id
from .graph import bind


def config_values(contracts: DataFrame, configs: DataFrame) -> DataFrame:
    """(contract_no, value): of the configurations whose module holds the contract's file those of the deepest module,
    if they agree on one value.

    contracts: (contract_no, repository_id, path, protocol); configs: (repository_id, path, protocol, value). Every folder
    a file lies in is a key, so the longest prefix is found by an equi-join. An empty protocol matches any.
    """
    prefixes = configs.select("repository_id", fn.module_prefix(F.col("path")).alias("prefix"), F.col("protocol").alias("of"), "value").distinct()
    parts = F.split(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    asked = contracts.select("contract_no", "repository_id", "protocol", F.explode(folders).alias("prefix"))
    met = asked.join(prefixes, ["repository_id", "prefix"]).filter((F.col("protocol") == "") | (F.col("protocol") == F.col("of")))
    depth = met.groupBy("contract_no", F.char_length("prefix").alias("depth")).agg(F.collect_set(F.when((F.col("value") != "") & ~F.contains("value", F.lit("${")), F.col("value"))).alias("values"))
    deepest = depth.groupBy("contract_no").agg(F.max_by("values", "depth").alias("values"))
    return deepest.filter(F.size("values") == 1).select("contract_no", F.get("values", F.lit(0)).alias("value"))


def located_contracts(symbols: DataFrame, contracts: DataFrame) -> DataFrame:
    """Contracts with an id, the id of their symbol, and service or broker from the nearest configuration."""
    rows = contracts.withColumns(
        {
            c: F.coalesce(c, F.lit(""))
            for c in ("service", "contract_key", "symbol", "signature", "confidence", "reason", "broker")
        }
    )
    rows = rows.withColumn("contract_no", F.xxhash64(*[F.col(c) for c in rows.columns]))
    named = rows.withColumnRenamed("symbol", "owner")
    bound = bind(named, symbols, F.col("owner"), signature=F.col("signature")).withColumn("symbol_id", F.col("symbol.uid"))
    bound = bound.drop("n", "symbol").withColumnRenamed("owner", "symbol")
    service = rows.filter("kind = 'service'").select("repository_id", "path", F.lit("").alias("protocol"), F.col("service").alias("value"))
    broker = rows.filter("kind = 'broker'").select(
        "repository_id", "path", F.when(F.contains("broker", F.lit(":")), F.substring_index("broker", ":", 1)).otherwise(F.col("contract_key")).alias("protocol"), F.col("broker").alias("value")
    )
    no_service = rows.filter("kind = 'http' and role = 'provider' and service = ''").withColumn("protocol", F.lit(""))
    no_broker = rows.filter("kind = 'mq' and broker <> '' and not contains(broker, ':')").withColumn("protocol", F.col("broker"))
    configured = config_values(no_service, service).unionByName(config_values(no_broker, broker))
    joined = bound.join(configured, "contract_no", "left")
    http = (F.col("kind") == "http") & (F.col("role") == "provider") & (F.col("service") == "")
    mq = F.col("kind") == "mq"
    made = F.when(F.contains("broker", F.lit(":")), F.col("broker")).otherwise(F.coalesce("value", F.lit("")))
    return joined.select(
        "contract_no",
        F.concat(F.lit("contract:"), symbol_id("repository_id", "path", F.concat_ws(":", "kind", "role", "contract_key"), "signature")).alias("contract_id"),
        "repository_id", "path", "line", "kind", "role",
        F.when(http, F.coalesce("value", F.lit(""))).otherwise(F.col("service")).alias("service"),
        "contract_key", "symbol", "signature", "confidence", "reason",
        F.when(mq, F.when(F.contains(made, F.lit(":")), made).otherwise("")).otherwise(F.col("broker")).alias("broker"),
        "symbol_id",
    )


def link_contracts(contracts: DataFrame) -> DataFrame:
    """One row per consumer: status, reason and its provider if there is one only.

    The candidates of a consumer are not gathered: providers are counted by what they are matched on first.
    """
    match_on = F.when(F.col("kind") == "http", F.col("service")).when(F.col("kind") == "mq", F.col("broker")).otherwise(F.lit(""))
    provided = contracts.filter("role = 'provider' and confidence <> 'unresolved'").withColumn("match_on", match_on)
    provided = provided.filter("kind = 'dubbo' or match_on <> ''").groupBy("kind", "contract_key", "match_on").agg(
        F.count(F.lit(1)).alias("n_providers"),
        F.min(F.struct("contract_id", "repository_id", "path", "line", "symbol", "symbol_id")).alias("provider"),
    )
    asked = contracts.filter("role = 'consumer'").withColumn("match_on", match_on)
    joined = asked.join(provided, ["kind", "contract_key", "match_on"], "left").withColumn("n_providers", F.coalesce("n_providers", F.lit(0)))
    dynamic = (F.col("confidence") == "unresolved") | F.contains("contract_key", F.lit("${")) | F.contains("service", F.lit("${"))
    early = (
        F.when(dynamic, "dynamic_contract")
        .when((F.col("kind") == "http") & ((F.col("service") == "") | F.startswith("contract_key", F.lit("ANY:"))), "missing_service_or_http_method")
        .when((F.col("kind") == "dubbo") & ~F.contains("contract_key", F.lit(".")), "unqualified_interface")
        .when((F.col("kind") == "mq") & (F.col("broker") == ""), "unknown_broker")
    )
    known = F.col("symbol_id").isNotNull() & F.col("provider.symbol_id").isNotNull()
    reason = (
        F.when(early.isNotNull(), early)
        .when((F.col("n_providers") == 1) & known, "exact_static_contract")
        .when(F.col("n_providers") > 1, "multiple_providers")
        .when(F.col("n_providers") == 1, "unresolved_contract_symbol")
        .otherwise("no_verified_provider")
    )
    joined = joined.withColumn("link_reason", reason)
    status = F.when(F.col("link_reason") == "exact_static_contract", "matched").when(F.col("link_reason") == "multiple_providers", "ambiguous").otherwise("unresolved")
    return joined.select(
        "contract_id", "kind", "contract_key", "service", "broker", F.col("repository_id").alias("repository"), F.col("path").alias("file"), "line",
        F.col("symbol").alias("consumer"), F.col("symbol_id").alias("consumer_id"), status.alias("status"), F.col("link_reason").alias("reason"),
        F.when(early.isNull(), F.col("n_providers")).otherwise(0).cast("long").alias("n_providers"),
        F.when(early.isNull() & (F.col("n_providers") == 1), F.col("provider")).alias("provider"),
    )


def contract_relations(links: DataFrame) -> DataFrame:
    """A relation per matched link: from consumer to provider, of messages from provider to consumer."""
    matched = links.filter("status = 'matched'")
    mq = F.col("kind") == "mq"
    ends = {
        "repository": (F.col("provider.repository_id"), F.col("repository")), "file": (F.col("provider.path"), F.col("file")),
        "line": (F.col("provider.line"), F.col("line")), "source": (F.col("provider.symbol"), F.col("consumer")),
        "target": (F.col("consumer"), F.col("provider.symbol")), "source_id": (F.col("provider.symbol_id"), F.col("consumer_id")),
        "target_id": (F.col("consumer_id"), F.col("provider.symbol_id")), "target_repository": (F.col("repository"), F.col("provider.repository_id")),
    }
    picked = {name: F.when(mq, a).otherwise(b).alias(name) for name, (a, b) in ends.items()}
    rows = matched.select(F.xxhash64("contract_id", "provider.contract_id").alias("edge_no"), *picked.values(), F.concat(F.lit("contract_"), "kind").alias("kind"))
    return rows.select(
        "edge_no", "repository", "file", "line", F.col("target").alias("name"), "kind", F.lit("probable").alias("confidence"), "source", "target",
        "source_id", "target_id", "target_repository", F.lit("exact_static_contract").alias("reason"), F.lit(None).cast("int").alias("target_arity"),
    )


def rebound_calls(relations: DataFrame, links: DataFrame, symbols: DataFrame) -> DataFrame:
    """Of calls through a matched remote interface those that lead to the provider's method, if it is one only, as they are now."""
    owner = lambda c: F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)
    calls = relations.filter("kind = 'calls'").select(
        "edge_no", "repository", owner("source").alias("consumer"), owner("target").alias("contract_key"), fn.short_name(F.col("target")).alias("method"), "target_arity"
    )
    remote = links.filter("kind = 'dubbo' and status = 'matched'").select(
        "repository", "consumer", "contract_key", F.col("provider.repository_id").alias("repository_id"), F.col("provider.symbol").alias("owner")
    ).distinct()
    met = calls.join(remote, ["repository", "consumer", "contract_key"])
    found = bind(met, symbols, F.concat_ws(".", "owner", "method"), arity=F.col("target_arity")).filter("n > 0")
    once = found.groupBy("edge_no").agg(F.sum("n").alias("n"), F.first("symbol", ignorenulls=True).alias("bound")).filter("n = 1 and bound is not null")
    made = {
        "name": F.col("bound.name"), "target": F.col("bound.name"), "target_id": F.col("bound.uid"), "target_repository": F.col("bound.repository_id"),
        "reason": F.lit("exact_dubbo_contract"), "confidence": F.lit("probable"),
    }
    return relations.join(once.select("edge_no", "bound"), "edge_no").select(*[made[c].alias(c) if c in made else F.col(c) for c in relations.columns])


def contract_report(contracts: DataFrame, links: DataFrame, diagnostics: DataFrame, repository: str | None, text: str, limit: int) -> dict[str, DataFrame]:
    """contracts (the first `limit` that match), their links, gaps, and one row of coverage, which tells of all that match."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    wanted = contracts.filter(~F.col("kind").isin("service", "broker"))
    told = diagnostics
    if repository:
        wanted, told = wanted.filter(F.col("repository_id") == repository), told.filter(F.col("repository") == repository)
    if text:
        wanted = wanted.filter(F.contains(F.lower(F.concat_ws(" ", "contract_key", "symbol", "service")), F.lit(text.lower())))
        files = wanted.select(F.col("repository_id").alias("repository"), F.col("path").alias("file")).distinct().withColumn("asked", F.lit(True))
        told = told.join(files, ["repository", "file"], "left").filter(F.coalesce("asked", F.lit(False)) | F.contains(F.lower("reason"), F.lit(text.lower()))).drop("asked")
    kept = wanted.orderBy("repository_id", "path", "line", "kind", "contract_key", "contract_no").limit(limit)
    mine = links.join(kept.select("contract_id").distinct(), "contract_id", "left_semi")
    open_links = links.join(wanted.select("contract_id").distinct(), "contract_id", "left_semi").filter("status <> 'matched'")
    counts = (
        wanted.agg(F.count(F.lit(1)).alias("matched"))
        .crossJoin(told.agg(F.count(F.lit(1)).alias("diagnostics")))
        .crossJoin(open_links.agg(F.count(F.lit(1)).alias("unresolved"), F.array_sort(F.collect_set("reason")).alias("open")))
    )
    reasons = F.concat(
        F.when(F.col("matched") > limit, F.array(F.lit("contract_limit"))).otherwise(F.array().cast("array<string>")),
        F.col("open"),
        F.when(F.col("diagnostics") > 0, F.array(F.lit("parser_diagnostics"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("diagnostics") > limit, F.array(F.lit("contract_gap_limit"))).otherwise(F.array().cast("array<string>")),
    )
    coverage = counts.select(
        (F.size(reasons) == 0).alias("complete"), ((F.col("matched") > limit) | (F.col("diagnostics") > limit)).alias("truncated"), reasons.alias("reasons"),
        "unresolved", "diagnostics", F.lit(limit).cast("long").alias("limit"), F.least("matched", F.lit(limit)).cast("long").alias("returned"), "matched",
    )
    gaps = told.orderBy("repository", "file", "line", "reason").limit(limit)
    return {"contracts": kept, "links": mine, "gaps": gaps, "coverage": coverage}
