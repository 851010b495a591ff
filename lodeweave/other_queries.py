"""Queries of inputs, requirements, refresh, rules, names and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bindings as B
from .functions import identifiers as fn
from .functions.sql import register
from .operators import index as I
from .operators import ranking as R
from .operators import search as S
from .operators.extract import extract_files, native
from .plans import analysis as A
from .queries import TEXT, _query, _search_sql
from .schemas import symbol_id
from .sources import inputs

WORDS = ["small", "ring", "license"]


@_query(
    """with found as (
  select item_id, generate_subscripts(words, 1) as pos, unnest(words) as keyword from (select item_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_/-]{2,}') as words from benchmark)
), once as (select item_id, min(pos) as pos, arg_min(keyword, pos) as keyword from found group by item_id, lower(keyword)),
numbered as (select item_id, row_number() over (partition by item_id order by pos) - 1 as keyword_no, keyword from once)
select item_id, cast(keyword_no as int) as keyword_no, keyword from numbered where keyword_no < 64"""
)
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.keyword_rows(B.table(spark, sf_dir, "benchmark"), "item_id", "text")


_REQ_SQL = f"""with {_search_sql(WORDS, 1000)}, summed as (
  select repository, file, line, name, kind, sum(score) as score from top group by all
), evidence as (
  select *, row_number() over (order by score desc, concat_ws('/', repository, file, cast(line as varchar), kind, name)) as rank_no from summed
)"""


@_query(f"{_REQ_SQL} select cast(rank_no as int) as rank_no, repository, file, cast(line as int) as line, name, kind, round(cast(score as double), 6) as score from evidence where rank_no <= 200")
def req_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence, _ = A.requirement_evidence(B.catalog(spark, sf_dir), WORDS)
    return evidence.select("rank_no", "repository", "file", "line", "name", "kind", F.round("score", 6).alias("score"))


@_query(
    f"{_REQ_SQL} select repository, cast(sum(n) as bigint) as evidence, round(cast(sum(best) as double), 6) as score from (select repository, file, count(*) as n, max(score) as best from evidence where rank_no <= 200 group by all) group by repository"
)
def req_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence, _ = A.requirement_evidence(B.catalog(spark, sf_dir), WORDS)
    return A.repository_candidates(evidence).withColumn("score", F.round("score", 6))


@_query(
    f"{_REQ_SQL}, own as (select repository, file, line, name, kind from evidence where rank_no <= 200 and kind in ('controller_method', 'route', 'mapper_statement', 'service_method', 'application_method', 'calls', 'queries_table')) "
    "select repository, count(*) as change_points from own group by repository"
)
def req_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.catalog(spark, sf_dir)
    evidence, _ = A.requirement_evidence(found, WORDS)
    _, changes = A.points(evidence, found)
    return changes.groupBy("repository").agg(F.count(F.lit(1)).alias("change_points"))


# --- inputs ----------------------------------------------------------------------


@_query(
    """with lines as (select conv_id, turn, generate_subscripts(l, 1) as line, trim(unnest(l)) as value from (select conv_id, turn, string_split(text, chr(10)) as l from conversations)),
paths as (select conv_id || ':' || turn as source_path, unnest(regexp_extract_all(text, '/(?:[A-Za-z0-9._-]+/?)+')) as value from conversations)
select 'business_term' as kind, value, conv_id || ':' || turn as source_path, cast(min(line) as int) as line, 'probable' as confidence from lines
where value <> '' and not regexp_matches(value, '/(?:[A-Za-z0-9._-]+/?)+') group by all
union all select distinct 'api_path', value, source_path, 0, 'certain' from paths"""
)
def input_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "conversations").select("text", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("source"))
    return inputs.text_facts(rows, "text", "source")


@_query(
    "select distinct 'field' as kind, unnest(json_keys(props)) as value, event_type || '.json' as source_path, 0 as line, 'certain' as confidence from events"
)
def json_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.table(spark, sf_dir, "events").select(F.concat("event_type", F.lit(".json")).alias("name"), "props").distinct()
    return inputs.documents_facts(events, "name", "props").filter("kind = 'field'")


@_query(
    """select path, count(*) as n, count(distinct page_id) as pages from (select page_id, unnest(regexp_extract_all(html, 'href="(/[^"?#]*)', 1)) as path from pages) group by path"""
)
def html_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inputs.link_paths(B.table(spark, sf_dir, "pages"), "html", "page_id")
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages"))


# --- refresh, status, snapshots ---------------------------------------------------


def _baselines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as files: the new baseline lacks every 13th, has others for every 7th, and the old one lacks every 11th."""
    orders = B.table(spark, sf_dir, "orders")
    place = ["o_orderpriority as repository_id", "'order/' || o_orderkey as path"]
    old = orders.filter("o_orderkey % 11 <> 0").selectExpr(*place, "sha2(o_orderstatus, 256) as content_hash")
    new = orders.filter("o_orderkey % 13 <> 0").selectExpr(*place, "sha2(case when o_orderkey % 7 = 0 then 'changed' else o_orderstatus end, 256) as content_hash")
    return old, new


_STATES_SQL = """states as (
  select o_orderpriority as repository_id, 'order/' || o_orderkey as path, case when o_orderkey % 11 = 0 then 'added' when o_orderkey % 13 = 0 then 'removed'
    when o_orderkey % 7 = 0 then 'changed' else 'unchanged' end as state
  from orders where not (o_orderkey % 11 = 0 and o_orderkey % 13 = 0)
)"""


@_query(f"with {_STATES_SQL} select * from states")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.compare_files(*_baselines(spark, sf_dir))


@_query(
    f"with {_STATES_SQL} select repository_id, count(*) filter (where state <> 'removed') as indexed_files, count(*) filter (where state in ('added', 'changed')) as changed_files, "
    "count(*) filter (where state = 'removed') as removed_files from states group by repository_id"
)
def refresh_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.refresh_totals(I.compare_files(*_baselines(spark, sf_dir)))


@_query(
    f"with {_STATES_SQL} select 'order/' || o_orderkey as path, 'old' as origin from orders where o_orderkey % 11 <> 0 and 'order/' || o_orderkey in (select path from states where state = 'unchanged') "
    "union all select path, 'new' from states where state in ('added', 'changed')"
)
def evidence_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of files as they were stay, those of removed ones go, those of others come from the new extraction."""
    old, new = _baselines(spark, sf_dir)
    states = I.compare_files(old, new)
    fresh = new.join(states.filter("state in ('added', 'changed')"), ["repository_id", "path"], "left_semi")
    rows = lambda df, origin: df.select("repository_id", "path", F.lit(origin).alias("origin"))
    return I.replace_evidence(rows(old, "old"), rows(fresh, "new"), states).select("path", "origin")


@_query(
    "with repos as (select distinct source from documents union all select r_name from region) select source as repository_id, count(d.doc_id) as file_count, "
    "count(d.doc_id) filter (where contains(d.text, 'License')) as diagnostic_count from repos left join documents d using (source) group by source"
)
def workspace_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are repositories without any file."""
    files = B.files(spark, sf_dir)
    repositories = files.select("repository_id").distinct().unionByName(B.table(spark, sf_dir, "region").select(F.col("r_name").alias("repository_id")))
    return I.workspace_status(repositories, files, files.filter(F.contains("content", F.lit("License"))))


@_query(
    "select 's' || s_suppkey as repository_id, case when s_suppkey % 5 = 0 then 'baseline_unknown' when s_suppkey % 3 = 0 or s_suppkey % 7 = 0 then 'stale' else 'up_to_date' end as state from supplier"
)
def baseline_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = B.table(spark, sf_dir, "supplier")
    found = suppliers.selectExpr("'s' || s_suppkey as repository_id", "s_name as baseline_commit", "case when s_suppkey % 5 = 0 then 'baseline_unknown' else 'baseline_known' end as baseline_state")
    indexed = suppliers.filter("s_suppkey % 7 <> 0").selectExpr("'s' || s_suppkey as repository_id", "case when s_suppkey % 3 = 0 then 'other' else s_name end as baseline_commit")
    return I.repository_states(found, indexed)


# --- feedback ----------------------------------------------------------------------

AT = 500


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "events").selectExpr(
        "event_id + 1 as revision", "event_type as subject_kind", "cast(user_id % 20 as string) as subject_key", "case when value > 10 then 'confirm' else 'reject' end as decision",
        "cast(event_id as string) as note", "cast(ts as string) as created_at",
    )


_RULES_SQL = f"""rules as (select event_type as kind, cast(user_id % 20 as varchar) as pattern, case when value > 10 then 'confirm' else 'reject' end as target,
  max(event_id + 1) as revision, cast(max(event_id) as varchar) as note from events where event_id + 1 <= {AT} group by all)"""


@_query(f"with {_RULES_SQL} select kind, pattern, target, note, revision from rules")
def rules_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rules_at(_feedback(spark, sf_dir), AT)


@_query(f"with {_RULES_SQL} select pattern, target, revision from rules where kind = 'click' and pattern in ('1', '2', '3')")
def rule_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = A.rules_at(_feedback(spark, sf_dir), AT).withColumn("kind", F.when(F.col("kind") == "click", "repository").otherwise(F.col("kind")))
    modules = spark.createDataFrame([("1",), ("2",), ("3",)], "repository string")
    return A.echo_rules(rules, modules).select("pattern", "target", "revision")


@_query(
    """select bool_and(value > 0.05) as complete, bool_or(value > 30) as truncated, cast(sum(event_id % 3) as bigint) as unresolved, cast(sum(event_id % 2) as bigint) as diagnostics,
  count(*) as returned, count(*) as matched, (select string_agg(event_type, ',' order by first_id) from (select event_type, min(event_id) as first_id from events group by 1)) as reasons from events"""
)
def coverage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = B.table(spark, sf_dir, "events").selectExpr(
        "event_id", "value > 0.05 as complete", "value > 30 as truncated", "event_id % 3 as unresolved", "event_id % 2 as diagnostics", "1 as returned", "1 as matched", "array(event_type) as reasons"
    )
    return R.merge_coverage(parts, "event_id").withColumn("reasons", F.array_join("reasons", ","))


# --- names and identities ------------------------------------------------------------


@_query("select user_id, event_type, min(event_id) as event_id, arg_min(value, event_id) as value from events group by all")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return R.first_of_key(rows, ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id", "value")


@_query(
    "select p_partkey, 'sym:' || sha256(p_brand || chr(0) || p_type || chr(0) || p_name || chr(0) || 'f(int)') as symbol_id from part"
)
def symbol_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "part").select("p_partkey", symbol_id("p_brand", "p_type", "p_name", F.lit("f(int)")).alias("symbol_id"))


@_query("select doc_id, sha256(text) as content_hash, left(sha256(source), 16) as workspace_hash from documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.left(F.sha2("source", 256), F.lit(16)).alias("workspace_hash"))


@_query("select page_id, url as clean_url from pages")
def url_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = B.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "://", "://user:secret@").alias("url"))
    return pages.select("page_id", fn.without_user_info(F.col("url")).alias("clean_url"))


_EXT = "['java','XML','yml','txt','sql','png','ts','md','class','vue']"


@_query(
    f"select p_partkey, 'src/f' || p_partkey || '.' || ({_EXT})[1 + p_partkey % 10] as path from part where p_partkey % 10 not in (3, 5, 8)"
)
def filter_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _EXT.replace("[", "array(").replace("]", ")")
    files = B.table(spark, sf_dir, "part").selectExpr("p_partkey", f"'src/f' || p_partkey || '.' || get({names}, cast(p_partkey % 10 as int)) as path")
    return files.filter(fn.is_supported(F.col("path")))


@_query(
    r"""select doc_id, rule from (select doc_id, text from documents), (values
  ('credential', '(?i)(password|passwd|secret|token|api[_-]?key)\s*[:=]\s*[''"]?[A-Za-z0-9_\-/+]{8,}'), ('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'),
  ('local_path', '(/(home|Users)/[A-Za-z0-9._-]+/|[A-Za-z]:\\Users\\[A-Za-z0-9._-]+)'), ('address', '(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}'),
  ('control', '[\x00-\x08\x0B\x0C\x0E-\x1F]')) r(rule, pattern) where regexp_matches(text, pattern)"""
)
def sensitive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(fn.sensitive_rules(F.col("text"))).alias("rule"))


@_query("select p_partkey, p_size % 4 as arity, 'm' || p_partkey as short_name, 'mod' || (p_size % 3) as module from part")
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arity of signatures with generics, last parts of names, modules of paths."""
    rows = B.table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "'A.m(' || array_join(slice(array('Map<K,V>', 'int', 'List<Map<A,B>>[]', 'x'), 1, p_size % 4), ',') || ')' as signature",
        "'a.b.m' || p_partkey as name", "'mod' || (p_size % 3) || '/src/main/A.java' as path",
    )
    return rows.select("p_partkey", fn.signature_arity(F.col("signature")).alias("arity"), fn.short_name(F.col("name")).alias("short_name"), fn.module_prefix(F.col("path")).alias("module"))


# --- extraction from sources made of table rows ----------------------------------------


#: Files that one task reads, about: parsing takes the time, and a small table is few splits however many rows it has.
FILES_A_TASK = 5_000


def _sources(spark: SparkSession, sf_dir: str, path: str, content: str) -> DataFrame:
    part = B.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    part = part.repartition(max(spark.sparkContext.defaultParallelism, part.count() // FILES_A_TASK), "p_partkey")
    return part.selectExpr("'r' || (p_partkey % 3) as repository_id", f"{path} as path", f"{content} as content")


@_query(
    "select 'p' || p_partkey || '/pom.xml' as path, case when i = 0 then null else 'maven:m' || p_partkey end as source, 'maven:' || case i when 0 then 'm' || p_partkey else 'dep' || i || '-' || p_size end as target, "
    "case when i = 0 then 'maven_module' else 'depends_on_module' end as kind from part, unnest(range(0, 3)) as t(i)"
)
def extract_maven(spark: SparkSession, sf_dir: str) -> DataFrame:
    pom = "'<project><artifactId>m' || p_partkey || '</artifactId><dependency><artifactId> dep1-' || p_size || ' </artifactId></dependency><artifactId>dep2-' || p_size || '</artifactId></project>'"
    return native.maven_modules(_sources(spark, sf_dir, "'p' || p_partkey || '/pom.xml'", pom)).select("path", "source", "target", "kind")


@_query(
    "select 'm' || p_partkey || '.xml' as path, 'db.M' || p_partkey || '.find' as source, 't' || (p_size % 10) as target, 'queries_table' as kind, 4 as line from part "
    "union all select 'm' || p_partkey || '.xml', 'db.M' || p_partkey || '.find', 'joined', 'queries_table', 5 from part "
    "union all select 'm' || p_partkey || '.xml', 'db.M' || p_partkey, 'db.M' || p_partkey || '.find', 'maps_statement', 4 from part "
    "union all select 'm' || p_partkey || '.xml', 'db.M' || p_partkey, 'db.M' || p_partkey || '.open', 'maps_statement', 6 from part"
)
def extract_mapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement that nothing closes has no tables."""
    xml = (
        "'<?xml version=\"1.0\"?>\\n<mapper namespace=\"db.M' || p_partkey || '\">\\n\\n<select id=\"find\">select a from t' || (p_size % 10) || '\\n join joined</select>\\n"
        "<update id=\"open\">update lost set a = 1'"
    )
    edges = extract_files(_sources(spark, sf_dir, "'m' || p_partkey || '.xml'", xml))["edges"]
    return edges.select("path", "source", "target", "kind", "line")


# Relations of the Java source below: source ($T the type, $M its method), target, kind, line, arity.
_JAVA_EDGES = [
    ("$M", "/seg' || p_size || '/item", "route", 17, None), ("$M", "app.OrderService.load' || (p_size % 5) || '", "calls", 19, 2), ("$M", "app.KafkaTemplate.send", "calls", 18, 2),
    ("$T", "OrderService", "uses", 12, None), ("$T", "KafkaTemplate", "uses", 13, None), ("$T", "StockApi", "uses", 14, None), ("$T", "lib.Base", "imports", 2, None),
    ("$T", "Base", "implements", 8, "-"), ("$T", "Api", "implements", 8, "-"), ("$T", "dubbo:StockApi", "dubbo_reference", 14, None), ("$T", "dubbo:C' || p_partkey || '", "dubbo_service", 8, None),
    ("$T", "feign:stock' || (p_size % 3) || '", "feign_client", 6, None), ("$T", "config:shop.limit", "uses_config", 15, None), ("$T", "config:app.c' || p_size || '", "uses_config", 7, None),
    ("$T", "mq:out' || p_size || '", "publishes_topic", 18, None), ("$T", "mq:in", "consumes_topic", 21, None), ("$T", "schedule:C' || p_partkey || '#tick", "scheduled_job", 23, None),
]


def _java_sql() -> str:
    place = {"$T": "'app.C' || p_partkey", "$M": "'app.C' || p_partkey || '.get'"}
    rows = [
        f"select 'C' || p_partkey || '.java' as path, {place[source]} as source, '{target}' as target, '{kind}' as kind, {line} as line, cast({arity if isinstance(arity, int) else 'null'} as int) as target_arity from part"
        for source, target, kind, line, arity in _JAVA_EDGES
    ]
    return " union all ".join(rows)


def _java_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = [
        "package app;", "import lib.Base;", "/* class Fake {} */", "@RestController", '@RequestMapping("/seg\' || p_size || \'")', '@FeignClient(name = "stock\' || (p_size % 3) || \'")',
        '@ConfigurationProperties(prefix = "app.c\' || p_size || \'")', "public class C' || p_partkey || ' extends Base implements Api {", "  // a comment", "  @DubboService", "  static class Inner { }",
        '  private OrderService orders; // not a "route"', "  private KafkaTemplate bus;", "  @DubboReference private StockApi stock;", '  @Value("\' || char(36) || \'{shop.limit:5}") int limit;',
        '  @GetMapping("/item")', "  public String get(String id, int n) {", '    bus.send("out\' || p_size || \'", id);', "    return orders.load' || (p_size % 5) || '(id, f(n, 1));", "  }",
        '  @KafkaListener(topics = "in")', "  public void on(String m) { }", '  @Scheduled(cron = "0 0 * * * *")', "  public void tick() { }", "}",
    ]
    lines[3] = "@RestController @DubboService"
    lines[9] = "  // another"
    java = "'" + "\\n".join(lines) + "'"
    return _sources(spark, sf_dir, "'C' || p_partkey || '.java'", java)


@_query(_java_sql())
def extract_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = extract_files(_java_sources(spark, sf_dir))["edges"]
    return edges.select("path", "source", "target", "kind", "line", "target_arity")


# Contracts of the same source: kind, role, key, symbol (the type, or a method of it), line, broker, reason.
_JAVA_CONTRACTS = [
    ("dubbo", "consumer", "app.StockApi", "", 14, "", "@DubboReference"), ("dubbo", "provider", "app.Api", "", 8, "", "@DubboService implements interface"),
    ("http", "provider", "GET:/seg' || p_size || '/item", ".get", 17, "", ""), ("mq", "provider", "out' || p_size || '", ".get", 18, "kafka", "message publish literal topic"),
    ("mq", "consumer", "in", ".on", 22, "kafka", "message listener literal topic"),
]


@_query(
    " union all ".join(
        f"select 'C' || p_partkey || '.java' as path, '{kind}' as kind, '{role}' as role, '{key}' as contract_key, 'app.C' || p_partkey || '{method}' as symbol, {line} as line, '{broker}' as broker, '{reason}' as reason from part"
        for kind, role, key, method, line, broker, reason in _JAVA_CONTRACTS
    )
)
def extract_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_files(_java_sources(spark, sf_dir))["contracts"]
    return found.select("path", "kind", "role", "contract_key", "symbol", "line", "broker", "reason")


@_query(_java_sql())
def extract_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations of the same sources by a table function of SQL."""
    register(spark)
    _java_sources(spark, sf_dir).createOrReplaceTempView("lodeweave_sources")
    return spark.sql("select path, e.source, e.target, e.kind, e.line, e.target_arity from lodeweave_sources, lateral extract_evidence(path, content) e where e.`table` = 'edge'")


@_query(
    "select 'c' || p_partkey || '.yml' as path, 'service' as kind, 'provider' as role, 'svc' || p_size as contract_key, 'svc' || p_size as service, '' as broker, 'config:c' || p_partkey || '.yml' as symbol, 3 as line from part union all "
    "select 'c' || p_partkey || '.yml', 'broker', 'provider', 'kafka', '', 'kafka:k' || (p_size % 7) || ':9092,k:1', 'config:c' || p_partkey || '.yml', 5 from part union all "
    "select 'c' || p_partkey || '.yml', 'broker', 'provider', 'rocketmq', '', 'rocketmq:n:' || p_size, 'config:c' || p_partkey || '.yml', 6 from part"
)
def extract_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in any case and spelling; blanks inside addresses go; a dynamic value names nothing."""
    yml = (
        "'spring:\\n  Application:\\n    name: svc' || p_size || '\\n  kafka:\\n    bootstrapServers: k' || (p_size % 7) || ':9092, k:1\\nrocketmq.nameServer=n:' || p_size || '\\n"
        "spring.rabbitmq.host: ' || char(36) || '{HOST}\\n'"
    )
    found = extract_files(_sources(spark, sf_dir, "'c' || p_partkey || '.yml'", yml))["contracts"]
    return found.select("path", "kind", "role", "contract_key", "service", "broker", "symbol", "line")


@_query("select 'v' || p_partkey || '.sql' as path, 'table:t' || p_size as target, 'migration_table' as kind from part union all select 'v' || p_partkey || '.sql', 'table:log', 'migration_table' from part")
def extract_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "'CREATE TABLE t' || p_size || ' (a int);\\ninsert into log values (1);'"
    return native.line_relations(_sources(spark, sf_dir, "'v' || p_partkey || '.sql'", sql), "migration_table").select("path", "target", "kind")


@_query("select 'f' || p_partkey || '.ts' as path, 'http:POST:/api/' || p_size as target, 'calls_http' as kind from part")
def extract_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = "'axios.post(\"/api/' || p_size || '\", x);'"
    return native.line_relations(_sources(spark, sf_dir, "'f' || p_partkey || '.ts'", code), "calls_http").select("path", "target", "kind")
