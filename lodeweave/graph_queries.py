"""Queries over the graph: resolution, walks, flows, context, contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bindings as B
from .operators import contracts as C
from .operators import context as X
from .operators import graph as G
from .queries import _query
from .schemas import evidence

START, DEPTH, LIMIT = "sales.order.o1", 6, 20


@_query(f"with {B.RESOLVED_SQL} select source, target, kind, line, source_id, target_id, reason from relations")
def graph_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.shop(spark, sf_dir)
    relations = G.resolve_relations(found.symbols, found.edges)
    return relations.select("source", "target", "kind", "line", "source_id", "target_id", "reason")


@_query(f"with {B.RESOLVED_SQL} select source, target, kind, line, source_id, target_id, reason from relations")
def graph_rebind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shop's relations from those of an older state, in which a quarter of its files was other or not there at all."""
    found = B.shop(spark, sf_dir)
    turn = F.pmod(F.xxhash64("path"), F.lit(8))
    renamed = F.when(turn == 1, F.concat(F.lit("old."), "name")).otherwise(F.col("name"))
    symbols = found.symbols.filter(turn != 0).withColumns({"name": renamed, "uid": F.when(turn == 1, F.concat(F.lit("old."), "uid")).otherwise(F.col("uid"))})
    edges = found.edges.filter(turn != 0).withColumn("target", F.when(turn == 1, F.concat(F.lit("old."), "target")).otherwise(F.col("target")))
    before = G.stored_relations(symbols, edges)
    state = F.when(turn == 0, "added").when(turn == 1, "changed").otherwise("unchanged").alias("state")
    states = found.symbols.select("repository_id", "path").unionByName(found.edges.select("repository_id", "path")).distinct().select("*", state)
    relations = G.rebind_relations(before, states, symbols, found.symbols, found.edges)
    return relations.select("source", "target", "kind", "line", "source_id", "target_id", "reason")


@_query(
    f"with {B.RESOLVED_SQL}, wishes as (select unnest(['geo.region.r0', 'region.r1', 'p3', 'geo.nation.n4@geo', 'nowhere']) as ask) "
    "select ask, uid from wishes join symbols on uid = ask union all "
    "select ask, uid from wishes join symbols s on s.name = ask union all "
    "select ask, uid from wishes join symbols s on ends_with(s.name, '.' || ask) where not exists (select 1 from symbols t where t.name = ask) and ask not like '%@%'"
)
def resolve_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = B.shop(spark, sf_dir).symbols
    out = None
    for ask in ("geo.region.r0", "region.r1", "p3", "geo.nation.n4@geo", "nowhere"):
        found = symbols.filter(F.col("uid") == ask) if "@" in ask else G.resolve_symbol(symbols, ask)
        found = found.select(F.lit(ask).alias("ask"), "uid")
        out = found if out is None else out.unionByName(found)
    return out


def _walk_sql(relations: str, start: str, depth: int, limit: int, reverse: bool = False) -> str:
    here, there = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    extra = ", source" if reverse else ""
    return f"""{relations}, near as (
  select *, row_number() over (partition by {here} order by repository, file, line, kind, target{extra}) as place from relations where {here} is not null and source_id is not null
), walked as (
  with recursive w as (
    select [] :: bigint[] as ord, '{start}' as node, ['{start}'] as seen, 0 as depth, 'open' as state, [] :: struct(source varchar, target varchar, kind varchar, reason varchar, source_id varchar, target_id varchar)[] as path
    union all
    select list_append(ord, place), {there}, list_append(seen, {there}), depth + 1,
      case when {there} is null then 'end' when list_contains(seen, {there}) then 'cycle' else 'open' end,
      list_append(path, struct_pack(source := n.source, target := n.target, kind := n.kind, reason := n.reason, source_id := n.source_id, target_id := n.target_id))
    from w join near n on n.{here} = w.node where state = 'open' and depth < {depth}
  ) select * from w
), leaves as (
  select w.*, case when state <> 'open' then state when exists (select 1 from near n where n.{here} = w.node) then 'depth' else 'leaf' end as final
  from walked w where len(ord) > 0 and (state <> 'open' or depth = {depth} or not exists (select 1 from near n where n.{here} = w.node))
), numbered as (
  select *, row_number() over (order by ord) as path_no, count(*) over () as all_paths from leaves
), kept as (select * from numbered where path_no <= {limit}), hops as (
  select path_no, hop_no, h.source, h.target, h.kind, h.reason, h.source_id, h.target_id
  from (select path_no, generate_subscripts(path, 1) as hop_no, unnest(path) as h from kept)
)"""


_SHOP_START = f"{START}@order/"


def _shop_walk(spark: SparkSession, sf_dir: str, target: str, depth: int, limit: int, reverse: bool = False):
    graph = G.open_graph(B.shop(spark, sf_dir))
    start, _, _ = G.one_start(graph, target)
    return graph, start, G.walk(graph, start, depth, limit, reverse)


_SHOWN = ["path_no", "hop_no", "source", "target", "kind", "reason"]
_HOPS = "cast(path_no as int) as path_no, cast(hop_no as int) as hop_no, source, target, kind, reason"
# The start's id has the order's status in it; sf tables differ in it, so the SQL looks it up.
_LOOK = "(select uid from symbols where name = 'sales.order.o1')"


def _shop_sql(depth: int, limit: int) -> str:
    sql = _walk_sql(B.RESOLVED_SQL, "START", depth, limit)
    return sql.replace("'START' as node, ['START'] as seen", f"{_LOOK} as node, [{_LOOK}] as seen")


@_query(f"with {_shop_sql(DEPTH, LIMIT)} select {_HOPS} from hops")
def trace_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _, found = _shop_walk(spark, sf_dir, START, DEPTH, LIMIT)
    return G.paths_frame(graph, found).select(*_SHOWN)


@_query(f"with {_shop_sql(DEPTH, LIMIT)} select {_HOPS} from hops")
def trace_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk on stored lists, as a snapshot has them: a node's relations are one row for each name they have for it."""
    graph = G.packed_graph(B.shop(spark, sf_dir))
    start, _, _ = G.one_start(graph, START)
    return G.paths_frame(graph, G.walk(graph, start, DEPTH, LIMIT)).select(*_SHOWN)


@_query(f"with {_walk_sql(B.TRANSITIONS_SQL, 'event.view', 4, 60)} select {_HOPS} from hops")
def trace_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = G.load_graph(B.transitions(spark, sf_dir))
    start, _, _ = G.one_start(graph, "event.view")
    return G.paths_frame(graph, G.walk(graph, start, 4, 60)).select(*_SHOWN)


def _routes(spark: SparkSession, sf_dir: str):
    """The shop's graph with a route of each nation."""
    found = B.shop(spark, sf_dir)
    routes = B.table(spark, sf_dir, "nation").selectExpr(
        "'shop' as repository_id", "'geo' as path", "'geo.nation.n' || n_nationkey as source", "'/nations/' || n_nationkey as target", "'route' as kind",
        "1 as line", "'certain' as confidence", "'' as source_signature", "cast(null as int) as target_arity",
    )
    return evidence(spark, symbols=found.symbols, edges=found.edges.unionByName(routes))


@_query(
    f"with {_walk_sql(B.RESOLVED_SQL.replace('relations as (', 'bound_relations as (') + ', relations as (select * from bound_relations union all select ' + chr(39) + 'shop' + chr(39) + ', ' + chr(39) + 'geo' + chr(39) + ', 1, ' + chr(39) + 'route' + chr(39) + ', ' + chr(39) + 'geo.nation.n' + chr(39) + ' || n_nationkey, ' + chr(39) + '/nations/' + chr(39) + ' || n_nationkey, ' + chr(39) + 'geo.nation.n' + chr(39) + ' || n_nationkey || ' + chr(39) + '@geo' + chr(39) + ', null, ' + chr(39) + 'terminal_evidence' + chr(39) + ' from nation)', 'geo.nation.n4@geo', 6, 20)} select {_HOPS} from hops"
)
def trace_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target that reads like a route starts at the route's owner."""
    graph = G.open_graph(_routes(spark, sf_dir))
    start, _, _ = G.one_start(graph, "/nations/4")
    return G.paths_frame(graph, G.walk(graph, start, 6, 20)).select(*_SHOWN)


@_query(
    f"with {_walk_sql(B.TRANSITIONS_SQL, 'event.view', 3, 10)} select (select count(*) from kept) as returned, max(all_paths) > 10 as truncated_paths, "
    "bool_or(path_no <= 10 and final = 'cycle') as has_cycle, bool_or(path_no <= 10 and final = 'depth') as has_depth_limit from numbered"
)
def walk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = G.load_graph(B.transitions(spark, sf_dir))
    start, _, _ = G.one_start(graph, "event.view")
    found = G.walk(graph, start, 3, 10).coverage()
    row = (found["returned"], "path_limit" in found["reasons"], "cycle_detected" in found["reasons"], "depth_limit" in found["reasons"])
    return spark.createDataFrame([row], "returned long, truncated_paths boolean, has_cycle boolean, has_depth_limit boolean")


@_query(f"with {_walk_sql(B.RESOLVED_SQL, 'geo.region.r1@geo', 2, 30, True)} select distinct source, target, kind, reason from hops")
def impact_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = G.open_graph(B.shop(spark, sf_dir))
    found = G.impact(graph, "geo.region.r1", max_depth=2, limit=30)
    rows = [(e["source"], e["target"], e["kind"], e["reason"]) for e in found["relations"]]
    return spark.createDataFrame(rows, "source string, target string, kind string, reason string")


@_query(
    f"with {B.RESOLVED_SQL} select source, target, kind, reason from relations where target_id is null and reason in ('ambiguous_target', 'unresolved_target') "
    "and (target = 'geo.region.r0' or target = 'region.r0')"
)
def unresolved_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open relations that may mean geo.region.r0, by its name or by what it is called in its repository."""
    found = B.shop(spark, sf_dir)
    relations = G.resolve_relations(found.symbols, found.edges)
    named = G.unresolved_incoming(relations, {"name": "geo.region.r0", "repository_id": "shop"})
    short = G.unresolved_incoming(relations, {"name": "region.r0", "repository_id": "shop"})
    return named.unionByName(short).select("source", "target", "kind", "reason")


@_query(
    f"with {_shop_sql(DEPTH, LIMIT)}, steps as (select path_no, hop_no as step_no, target as name, kind, coalesce((select s.kind from symbols s where s.uid = hops.target_id), kind) as lead "
    f"from hops union all select path_no, 0, '{START}', 'controller_method', 'controller_method' from kept) "
    "select cast(path_no as int) as path_no, cast(step_no as int) as step_no, name, kind, case when lead in ('controller', 'controller_method', 'route') then 'entry' when lead in ('application', 'application_method') then 'application' "
    "when lead in ('repository', 'repository_method') then 'repository' when lead in ('mapper', 'mapper_method', 'mapper_statement', 'maps_statement') then 'mapper' "
    "when lead in ('queries_table', 'migration_table') then 'table' else 'domain_or_service' end as stage, false as crosses from steps"
)
def flow_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, start, found = _shop_walk(spark, sf_dir, START, DEPTH, LIMIT)
    return X.flow_steps(G.paths_frame(graph, found), graph.symbols, start)


@_query(
    """with links as (
  select c_custkey, c_nationkey as n, 'web.Client' || c_custkey || '.run' as consumer, 'api.Nation' || c_nationkey || '.find' as provider from customer where c_custkey % 7 = 0
) select path_no, hop_no as step_no, name, stage, crosses from (
  select cast(row_number() over (order by c_custkey) as int) as path_no, c_custkey, consumer, provider from links order by c_custkey limit 20
), lateral (values (0, 'web.Gate.open', 'entry', false), (1, consumer, 'domain_or_service', false), (2, provider, 'cross_service', true)) steps(hop_no, name, stage, crosses)"""
)
def flow_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow from a controller over its clients into the repositories whose contracts they consume."""
    customers, nations = B.table(spark, sf_dir, "customer").filter("c_custkey % 7 = 0"), B.table(spark, sf_dir, "nation")
    place = ["1 as line", "9 as end_line", "'' as signature", "'a.java' as path"]
    symbols = customers.selectExpr("'shop' as repository_id", "'web.Client' || c_custkey || '.run' as name", "'service_method' as kind", *place)
    symbols = symbols.unionByName(nations.selectExpr("'nation' || n_nationkey as repository_id", "'api.Nation' || n_nationkey || '.find' as name", "'service_method' as kind", *place))
    symbols = symbols.unionByName(nations.filter("n_nationkey = 0").selectExpr("'shop' as repository_id", "'web.Gate.open' as name", "'controller_method' as kind", *place))
    edges = customers.selectExpr("'shop' as repository_id", "'a.java' as path", "'web.Gate.open' as source", "'web.Client' || c_custkey || '.run' as target", "'calls' as kind", "cast(c_custkey as int) as line", "'certain' as confidence")
    shape = ["'http' as kind", "'a.java' as path", "'certain' as confidence", "1 as line"]
    asked = customers.selectExpr("'shop' as repository_id", "'consumer' as role", "'nation' || c_nationkey as service", "'GET:/find' as contract_key", "'web.Client' || c_custkey || '.run' as symbol", *shape)
    given = nations.selectExpr("'nation' || n_nationkey as repository_id", "'provider' as role", "'nation' || n_nationkey as service", "'GET:/find' as contract_key", "'api.Nation' || n_nationkey || '.find' as symbol", *shape)
    graph = G.load_graph(evidence(spark, symbols=symbols, edges=edges, contracts=asked.unionByName(given)))
    start, _, _ = G.one_start(graph, "web.Gate.open")
    steps = X.flow_steps(G.paths_frame(graph, G.walk(graph, start, DEPTH, LIMIT)), graph.symbols, start)
    return steps.select("path_no", "step_no", "name", "stage", "crosses")


_NEAR_SQL = f"""{B.RESOLVED_SQL}, near as (
  select distinct 'callers' as category, repository, file, line, kind, source, target, source_id, target_id from relations where target_id like 'geo.nation.n3@%' and source_id is not null
  union all
  select distinct case when kind = 'calls' then 'callees' else 'related' end, repository, file, line, kind, source, target, source_id, target_id from relations where source_id like 'geo.nation.n3@%'
)"""


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = "geo.nation.n3@geo"
    return X.neighbours(G.open_graph(B.shop(spark, sf_dir)).touching([node]), node)


@_query(f"with {_NEAR_SQL} select category, source, target, kind, line from near")
def context_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).select("category", "source", "target", "kind", "line")


@_query(
    f"with {_NEAR_SQL} select category, source, target, kind from (select *, row_number() over (order by case category when 'callers' then 0 when 'callees' then 1 else 2 end, "
    "repository, file, line, kind, target, source) as no from near) where no <= 15"
)
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.budgeted(_near(spark, sf_dir), 15).select("category", "source", "target", "kind")


@_query(f"with {_NEAR_SQL} select category, count(*) as n from near group by category")
def context_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@_query(
    f"with {_shop_sql(DEPTH, LIMIT)}, chosen as (select distinct path_no from kept where path_no <= 3), steps as (select path_no, hop_no as step_no, target as name from hops "
    f"union all select path_no, 0, '{START}' from kept) select cast(path_no as int) as path_no, cast(step_no as int) as step_no, name from steps join chosen using (path_no) where step_no < 4"
)
def context_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = G.open_graph(B.shop(spark, sf_dir))
    told = X.context(graph, START, max_depth=DEPTH, limit=LIMIT)
    rows = [
        (p, s, step["evidence"].get("target") or step["evidence"]["name"])
        for p, one in enumerate(told["flows"], 1)
        for s, step in enumerate(one["steps"])
    ]
    return spark.createDataFrame(rows, "path_no int, step_no int, name string")


@_query(f"with {B.MARKET_SQL} select consumer, service, contract_key, reason, cast(n_providers as bigint) as n_providers, provider from links")
def contract_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = C.located_contracts(B.shop(spark, sf_dir).symbols, evidence(spark, contracts=B.market(spark, sf_dir)).contracts)
    links = C.link_contracts(located)
    return links.select("consumer", "service", "contract_key", "reason", "n_providers", F.col("provider.symbol").alias("provider"))


@_query(
    f"with {B.MARKET_SQL}, wanted as (select 'c' as role, consumer as symbol, contract_key, service from consumers where contains(lower(contract_key || ' ' || consumer || ' ' || service), 'nation7') "
    "union all select 'p', case when s_suppkey % 11 = 0 then 'none' else 'supply.s' || s_suppkey end, 'GET:/seg/' || (s_suppkey % 5), 'nation' || s_nationkey from supplier where s_nationkey = 7) "
    "select (select count(*) from wanted) as matched, (select count(*) from wanted) <= 1000 and not exists (select 1 from links where service = 'nation7' and reason <> 'exact_static_contract') as complete, "
    "(select count(*) from links where service = 'nation7' and reason <> 'exact_static_contract') as unresolved"
)
def contract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = C.located_contracts(B.shop(spark, sf_dir).symbols, evidence(spark, contracts=B.market(spark, sf_dir)).contracts)
    none = spark.createDataFrame([], "repository string, file string, line int, reason string, confidence string")
    told = C.contract_report(located, C.link_contracts(located), none, None, "nation7", 1000)
    return told["coverage"].select("matched", "complete", "unresolved")


_HOST = "split_part(split_part(url, '/', 3), '?', 1)"
_PATH = r"regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"


@_query(
    rf"""with places as (select page_id, {_HOST} as host, {_PATH} as path from pages), configs as (
  select distinct host, string_split(path, '/')[1] as prefix, 'svc-' || string_split(path, '/')[1] as value from places where contains(path, '/')
  union all select distinct host, '', 'svc-root' from places union all select distinct host, 'de', 'svc-other' from places
), met as (select page_id, length(prefix) as depth, value, max(length(prefix)) over (partition by page_id) as best
  from places join configs using (host) where prefix = '' or starts_with(path, prefix || '/')
) select page_id, min(value) as value from met where depth = best group by page_id having count(distinct value) = 1"""
)
def config_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service of each page's folder: that of the deepest module which holds it, if it has one only."""
    places = B.table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("repository_id"), F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1).alias("path")
    )
    folder = F.split_part("path", F.lit("/"), F.lit(1))
    own = places.filter(F.contains("path", F.lit("/"))).select("repository_id", F.concat(folder, F.lit("/app.yml")).alias("path"), F.concat(F.lit("svc-"), folder).alias("value"))
    top = places.select("repository_id", F.lit("app.yml").alias("path"), F.lit("svc-root").alias("value"))
    german = places.select("repository_id", F.lit("de/other.yml").alias("path"), F.lit("svc-other").alias("value"))
    configs = own.unionByName(top).unionByName(german).distinct().withColumn("protocol", F.lit(""))
    asked = places.select(F.col("page_id").alias("contract_no"), "repository_id", "path", F.lit("").alias("protocol"))
    return C.config_values(asked, configs).select(F.col("contract_no").alias("page_id"), "value")


@_query(
    """select 'web.Client' || c_custkey || '.run' as source, case when n % 5 <> 0 then 'impl.Nation' || n || '.find' else 'api.Nation' || n || '.find' end as target,
  case when n % 5 <> 0 then 'geo' end as target_repository, case when n % 5 <> 0 then 'exact_dubbo_contract' else 'unresolved_target' end as reason
from (select c_custkey, c_nationkey as n from customer)"""
)
def rpc_rebind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a remote interface lead to the method of its only provider in another repository."""
    customers, nations = B.table(spark, sf_dir, "customer"), B.table(spark, sf_dir, "nation")
    place = ["'a.java' as path", "1 as line", "9 as end_line", "'' as signature", "'class' as kind"]
    symbols = customers.selectExpr("'shop' as repository_id", "'web.Client' || c_custkey as name", *place)
    symbols = symbols.unionByName(customers.selectExpr("'shop' as repository_id", "'web.Client' || c_custkey || '.run' as name", *place))
    symbols = symbols.unionByName(nations.selectExpr("'geo' as repository_id", "'impl.Nation' || n_nationkey as name", *place))
    symbols = symbols.unionByName(nations.filter("n_nationkey % 5 <> 0").selectExpr("'geo' as repository_id", "'impl.Nation' || n_nationkey || '.find' as name", *place))
    edges = customers.selectExpr(
        "'shop' as repository_id", "'a.java' as path", "'web.Client' || c_custkey || '.run' as source", "'api.Nation' || c_nationkey || '.find' as target",
        "'calls' as kind", "2 as line", "'certain' as confidence",
    )
    shape = ["'dubbo' as kind", "'a.java' as path", "'certain' as confidence", "1 as line"]
    consumers = customers.selectExpr("'shop' as repository_id", "'consumer' as role", "'api.Nation' || c_nationkey as contract_key", "'web.Client' || c_custkey as symbol", *shape)
    providers = nations.selectExpr("'geo' as repository_id", "'provider' as role", "'api.Nation' || n_nationkey as contract_key", "'impl.Nation' || n_nationkey as symbol", *shape)
    graph = G.load_graph(evidence(spark, symbols=symbols, edges=edges, contracts=consumers.unionByName(providers)))
    return graph.relations.filter("kind = 'calls'").select("source", "target", "target_repository", "reason")
