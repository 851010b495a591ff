"""Views that give the driver's tables the shape of evidence, in Spark and (for the oracle) in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import Evidence, evidence


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts):
    return F.concat(*[F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("source").alias("repository_id"), _text("doc/", "$doc_id").alias("path"), F.sha2("text", 256).alias("content_hash"), F.col("text").alias("content")
    )


FILES_SQL = "files as (select source as repository_id, 'doc/' || doc_id as path, text as content from documents)"


def catalog(spark: SparkSession, sf_dir: str) -> Evidence:
    """Files of documents, symbols of parts, relations of line items: what ranked search looks through."""
    part = table(spark, sf_dir, "part")
    camel = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    symbols = part.select(
        F.col("p_brand").alias("repository_id"), _text("part/", "$p_type").alias("path"), F.concat(F.lit("catalog."), camel, F.lit(".p"), F.col("p_partkey").cast("string")).alias("name"),
        F.lit("service_method").alias("kind"), F.col("p_size").alias("line"), _text("u", "$p_partkey").alias("uid"), F.lit("").alias("signature"), F.col("p_size").alias("end_line"),
    )
    item = table(spark, sf_dir, "lineitem")
    edges = item.select(
        F.col("l_returnflag").alias("repository_id"), _text("line/", "$l_linestatus").alias("path"), _text("order.o", "$l_orderkey").alias("source"), _text("part.p", "$l_partkey").alias("target"),
        F.lit("calls").alias("kind"), F.col("l_linenumber").alias("line"), F.lit("certain").alias("confidence"), F.lit("").alias("source_signature"), F.lit(None).cast("int").alias("target_arity"),
    )
    return evidence(spark, files=files(spark, sf_dir), symbols=symbols, edges=edges)


CATALOG_SQL = FILES_SQL + r""", symbols as (
  select p_brand as repository_id, 'part/' || p_type as path,
    'catalog.' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '') || '.p' || p_partkey as name,
    'service_method' as kind, p_size as line, 'u' || p_partkey as uid, p_size as end_line from part
), edges as (
  select l_returnflag as repository_id, 'line/' || l_linestatus as path, 'order.o' || l_orderkey as source, 'part.p' || l_partkey as target,
    'calls' as kind, l_linenumber as line from lineitem
)"""


# --- the shop graph ----------------------------------------------------------

_SHOP_SYMBOLS = [
    # table, name, kind, path, line
    ("customer", "'sales.customer.c' || c_custkey", "service_method", "'customer/' || c_nationkey", "c_custkey % 97 + 1", ""),
    ("orders", "'sales.order.o' || o_orderkey", "controller_method", "'order/' || o_orderstatus", "o_orderkey % 89 + 1", ""),
    ("part", "'catalog.part.p' || p_partkey", "mapper_statement", "'part/' || p_size", "p_partkey % 83 + 1", ""),
    ("supplier", "'supply.s' || s_suppkey", "application_method", "'supplier/' || s_nationkey", "s_suppkey % 79 + 1", ""),
    ("nation", "'geo.nation.n' || n_nationkey", "repository", "'geo'", "n_nationkey + 1", ""),
    ("region", "'geo.region.r' || r_regionkey", "mapper", "'geo'", "r_regionkey + 1", ""),
    ("region", "'geo.region.r' || r_regionkey", "mapper", "'geo2'", "r_regionkey + 1", "where r_regionkey = 0"),
]
_SHOP_EDGES = [
    # table, source, target, kind, path, line
    ("orders", "'sales.order.o' || o_orderkey", "'sales.customer.c' || o_custkey", "calls", "'order/' || o_orderstatus", "1", ""),
    ("lineitem", "'sales.order.o' || l_orderkey", "'part.p' || l_partkey", "calls", "'items'", "l_linenumber + 1", ""),
    ("lineitem", "'sales.order.o' || l_orderkey", "'s' || l_suppkey", "uses", "'items'", "l_linenumber + 1", ""),
    ("customer", "'sales.customer.c' || c_custkey", "'nation.n' || c_nationkey", "uses", "'customer/' || c_nationkey", "c_custkey % 97 + 2", ""),
    ("customer", "'sales.customer.c' || c_custkey", "'table:' || c_mktsegment", "queries_table", "'customer/' || c_nationkey", "c_custkey % 97 + 3", ""),
    ("supplier", "'supply.s' || s_suppkey", "'geo.nation.n' || s_nationkey", "implements", "'supplier/' || s_nationkey", "s_suppkey % 79 + 1", ""),
    ("nation", "'geo.nation.n' || n_nationkey", "'region.r' || n_regionkey", "maps_statement", "'geo'", "n_nationkey + 1", ""),
    ("nation", "'geo.nation.n' || n_nationkey", "'geo.planet.x'", "calls", "'geo'", "n_nationkey + 2", "where n_nationkey % 5 = 4"),
    ("nation", "'geo.nation.n' || n_nationkey", "'javax.inject'", "imports", "'geo'", "1", ""),
]


def _union(rows: list[str]) -> str:
    return "\n  union all ".join(rows)


SHOP_SYMBOLS_SQL = _union(
    [f"select 'shop' as repository_id, {path} as path, {name} as name, '{kind}' as kind, cast({line} as int) as line, {name} || '@' || {path} as uid from {t} {w}" for t, name, kind, path, line, w in _SHOP_SYMBOLS]
)
SHOP_EDGES_SQL = _union(
    [f"select 'shop' as repository_id, {path} as path, {source} as source, {target} as target, '{kind}' as kind, cast({line} as int) as line from {t} {w}" for t, source, target, kind, path, line, w in _SHOP_EDGES]
)

RESOLVED_SQL = f"""symbols as ({SHOP_SYMBOLS_SQL}), edges as ({SHOP_EDGES_SQL}), keys as (
  select name as key, 0 as tier, uid from symbols
  union all select string_split(name, '.')[-1], 1, uid from symbols
  union all select array_to_string(string_split(name, '.')[-2:], '.'), 2, uid from symbols where len(string_split(name, '.')) > 2
), asked as (
  select distinct target, case len(string_split(target, '.')) when 1 then 1 when 2 then 2 else 0 end as most from edges
), met as (
  select target, tier, uid, min(tier) over (partition by target) as best
  from asked join keys on keys.key = asked.target and (tier = 0 or tier = most)
), bound as (
  select target, count(*) as n, min(uid) as uid from met where tier = best group by target
), owners as (
  select name, min(uid) as uid from symbols group by name having count(*) = 1
), relations as (
  select e.repository_id as repository, e.path as file, e.line, e.kind, e.source, e.target, o.uid as source_id,
    case when e.kind = 'queries_table' then null when b.n = 1 then b.uid end as target_id,
    case when e.kind = 'queries_table' then 'terminal_evidence' when b.n = 1 then '' when b.n > 1 then 'ambiguous_target' else 'unresolved_target' end as reason
  from edges e left join bound b on b.target = e.target left join owners o on o.name = e.source
  where e.kind <> 'imports'
)"""


def shop(spark: SparkSession, sf_dir: str, contracts: DataFrame | None = None) -> Evidence:
    """The foreign keys of the tables as a graph of symbols and relations in one repository."""

    def view(rows: list[tuple], made) -> DataFrame:
        out = None
        for row in rows:
            df = table(spark, sf_dir, row[0])
            if row[-1]:
                df = df.filter(row[-1].removeprefix("where "))
            df = df.selectExpr(*made(row))
            out = df if out is None else out.unionByName(df)
        return out

    def symbol(row: tuple) -> list[str]:
        _, name, kind, path, line, _ = row
        return ["'shop' as repository_id", f"{path} as path", f"{name} as name", f"'{kind}' as kind", f"cast({line} as int) as line",
                f"{name} || '@' || {path} as uid", "'' as signature", f"cast({line} as int) + 5 as end_line"]

    def edge(row: tuple) -> list[str]:
        _, source, target, kind, path, line, _ = row
        return ["'shop' as repository_id", f"{path} as path", f"{source} as source", f"{target} as target", f"'{kind}' as kind",
                f"cast({line} as int) as line", "'certain' as confidence", "'' as source_signature", "cast(null as int) as target_arity"]

    return evidence(spark, symbols=view(_SHOP_SYMBOLS, symbol), edges=view(_SHOP_EDGES, edge), contracts=contracts)


# --- transitions of events: five nodes with cycles ---------------------------


def transitions(spark: SparkSession, sf_dir: str) -> Evidence:
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    pairs = events.select("event_type", following.alias("following")).filter("following is not null").distinct()
    symbols = events.select("event_type").distinct().select(
        F.lit("web").alias("repository_id"), F.lit("events").alias("path"), _text("event.", "$event_type").alias("name"), F.lit("service_method").alias("kind"),
        F.lit(1).alias("line"), _text("event.", "$event_type").alias("uid"), F.lit("").alias("signature"), F.lit(1).alias("end_line"),
    )
    edges = pairs.select(
        F.lit("web").alias("repository_id"), F.lit("events").alias("path"), _text("event.", "$event_type").alias("source"), _text("event.", "$following").alias("target"),
        F.lit("calls").alias("kind"), F.lit(1).alias("line"), F.lit("certain").alias("confidence"), F.lit("").alias("source_signature"), F.lit(None).cast("int").alias("target_arity"),
    )
    return evidence(spark, symbols=symbols, edges=edges)


TRANSITIONS_SQL = """relations as (
  select distinct 'web' as repository, 'events' as file, 1 as line, 'calls' as kind, 'event.' || event_type as source, 'event.' || following as target,
    'event.' || event_type as source_id, 'event.' || following as target_id, '' as reason
  from (select event_type, lead(event_type) over (partition by user_id order by event_id) as following from events) where following is not null
)"""


# --- contracts: customers consume, suppliers provide --------------------------


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = "array_position(array('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'), c_mktsegment)"
    fixed = "'' as signature, cast(1 as int) as line, 'certain' as confidence, '' as reason, '' as broker"
    consumers = table(spark, sf_dir, "customer").selectExpr(
        "'shop' as repository_id", "'customer/' || c_nationkey as path", "'http' as kind", "'consumer' as role", "'nation' || c_nationkey as service",
        f"case when c_custkey % 50 = 0 then 'ANY:' else 'GET:' end || '/seg/' || ({segments} % 5) as contract_key", "'sales.customer.c' || c_custkey as symbol", *fixed.split(", ")
    )
    providers = table(spark, sf_dir, "supplier").selectExpr(
        "'shop' as repository_id", "'supplier/' || s_nationkey as path", "'http' as kind", "'provider' as role", "'nation' || s_nationkey as service",
        "'GET:/seg/' || (s_suppkey % 5) as contract_key", "case when s_suppkey % 11 = 0 then 'none' else 'supply.s' || s_suppkey end as symbol", *fixed.split(", ")
    )
    return consumers.unionByName(providers)


MARKET_SQL = """consumers as (
  select 'nation' || c_nationkey as service, 'sales.customer.c' || c_custkey as consumer, c_nationkey,
    case when c_custkey % 50 = 0 then 'ANY:' else 'GET:' end || '/seg/' ||
    (coalesce(list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment), 0) % 5) as contract_key
  from customer
), providers as (
  select 'nation' || s_nationkey as service, 'GET:/seg/' || (s_suppkey % 5) as contract_key, count(*) as n,
    min(case when s_suppkey % 11 = 0 then 'none' else 'supply.s' || s_suppkey end) as provider
  from supplier group by all
), links as (
  select consumer, c.service, c.contract_key,
    case when c.contract_key like 'ANY:%' then 0 else coalesce(n, 0) end as n_providers,
    case when c.contract_key like 'ANY:%' then 'missing_service_or_http_method' when n = 1 and provider <> 'none' then 'exact_static_contract'
      when n > 1 then 'multiple_providers' when n = 1 then 'unresolved_contract_symbol' else 'no_verified_provider' end as reason,
    case when c.contract_key not like 'ANY:%' and n = 1 then provider end as provider
  from consumers c left join providers p on p.service = c.service and p.contract_key = c.contract_key
)"""
