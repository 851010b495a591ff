"""The registered queries of the evidence engine over the driver's tables, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bindings as B
from .functions import identifiers as fn
from .operators import search as S
from .staging import stage

_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# --- search --------------------------------------------------------------------

TEXT = "Small Ring"
FILE_TEXT = "the thing"
_ASKED = {
    "search_substring": [FILE_TEXT, "%", "Licensed under"],
    "search_fts": [FILE_TEXT, "license", "doc 7", "también für"],
    "search_symbols": ["SmallRing", "small_ring", "catalog.RedWidget.p1"],
}


def _asked_sql(texts: list[str]) -> str:
    rows = ", ".join(f"({i}, '{t}')" for i, t in enumerate(texts))
    return (
        f"asked as (select query_no, text, lower(regexp_replace(text, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) as query, "
        "list_filter(string_split_regex(lower(regexp_replace(text, '(\\p{Ll})(\\p{Lu})', '\\1 \\2', 'g')), '[^\\p{L}\\p{Nd}]+'), lambda t: t <> '') as terms "
        f"from (values {rows}) v(query_no, text))"
    )


def _score_sql(name: str, scores: tuple) -> str:
    terms = f"list_filter(string_split_regex(lower(regexp_replace({name}, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g')), '[^\\p{{L}}\\p{{Nd}}]+'), lambda t: t <> '')"
    runs = f"flatten(list_transform(range(1, len({terms}) + 1), lambda s: list_transform(range(s, len({terms}) + 1), lambda e: array_to_string(({terms})[s:e], ''))))"
    return f"case when lower({name}) = lower(text) then {scores[0]} when list_contains({runs}, query) then {scores[1]} else {scores[2]} end"


def _has_terms(text: str) -> str:
    return f"len(terms) > 0 and len(list_filter(terms, lambda t: not contains(lower({text}), t))) = 0"


_LINE_SQL = (
    "case when instr(lower(content), lower(text)) = 0 then 1 else "
    "length(left(lower(content), instr(lower(content), lower(text)) - 1)) - length(replace(left(lower(content), instr(lower(content), lower(text)) - 1), chr(10), '')) + 1 end"
)

_FTS_SQL = r"""tokens as (
  select repository_id, path, unnest(regexp_extract_all(strip_accents(lower(repository_id || ' ' || path || ' ' || content)), '[\p{L}\p{N}]+')) as token from files
), lengths as (
  select repository_id, path, count(*) as length from tokens group by all
), corpus as (
  select (select count(*) from files) as n, (select sum(length) from lengths) / (select count(*) from files) as average
), postings as (
  select repository_id, path, token, count(*) as tf from tokens where token in (select strip_accents(unnest(terms)) from asked) group by all
), seen as (
  select token, count(*) as df from postings group by token
), scored as (
  select p.*, case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end
    * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average)) as part
  from postings p join seen using (token) join lengths using (repository_id, path) cross join corpus
), wanted as (
  select distinct query_no, strip_accents(unnest(terms)) as token from asked
), sizes as (
  select query_no, count(*) as size from wanted group by query_no
), ranks as (
  select query_no, repository_id, path, rank from (
    select query_no, repository_id, path, -sum(part) as rank, count(*) as had from wanted join scored using (token) group by all
  ) join sizes using (query_no) where had = size
)"""


def _search_sql(texts: list[str], limit: int, where: str = "") -> str:
    scope = f"and repository_id = '{where}'" if where else ""
    sym, edge = _score_sql("name", fn.SYMBOL_SCORES), (_score_sql("source", fn.EDGE_SCORES), _score_sql("target", fn.EDGE_SCORES))
    return f"""{B.CATALOG_SQL}, {_asked_sql(texts)}, {_FTS_SQL}, found as (
  select query_no, repository_id as repository, path as file, line, name, kind, '' as source, '' as target, {sym} as score, 'symbol' as match,
    row_number() over (partition by query_no order by case when lower(name) = lower(text) then 0 when suffix(translate(lower(name), '_-.', ''), query) then 1 else 2 end,
      repository_id, path, line, name) as place
  from symbols, asked where {_has_terms("name")} {scope}
  union all
  select query_no, repository_id, path, line, target, kind, source, target, greatest({edge[0]}, {edge[1]}), 'edge',
    row_number() over (partition by query_no order by case when lower(source) = lower(text) or lower(target) = lower(text) then 0 else 1 end, repository_id, path, line, target, source)
  from edges, asked where {_has_terms("(source || ' ' || target)")} {scope}
  union all
  select query_no, repository_id, path, {_LINE_SQL}, text, 'text', '', '', 300 + greatest(-rank, 0) / (60 + greatest(-rank, 0)), 'file_fts',
    row_number() over (partition by query_no order by rank, repository_id, path)
  from ranks join files using (repository_id, path) join asked using (query_no) where true {scope}
  union all
  select query_no, repository_id, path, {_LINE_SQL}, text, 'text', '', '', 200, 'file_substring',
    row_number() over (partition by query_no order by repository_id, path)
  from files, asked where contains(lower(content), lower(text)) {scope}
), fused as (
  select query_no, repository, file, line, name, kind, source, target, max(score) as score, string_agg(distinct match, ',' order by match) as match_sources
  from found where place <= {S.CANDIDATE_LIMIT} group by all
), ranked as (
  select *, row_number() over (partition by query_no order by score desc, repository, file, line, kind, name, source, target) as rank_no from fused
), top as (select * from ranked where rank_no <= {limit})"""


_TOP = "query_no, cast(rank_no as int) as rank_no, repository, file, cast(line as int) as line, name, kind, source, target, round(cast(score as double), 6) as score, match_sources"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(
        "query_no", "rank_no", "repository", "file", "line", "name", "kind", "source", "target", F.round("score", 6).alias("score"), F.array_join("match_sources", ",").alias("match_sources")
    )


def _search(spark, sf_dir, texts, limit, repository=None):
    found = B.catalog(spark, sf_dir)
    return S.ranked_search(found, S.queries_frame(spark, texts), repository, limit)


@_query(f"with {_search_sql([TEXT, FILE_TEXT], 50)} select {_TOP} from top")
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_search(spark, sf_dir, [TEXT, FILE_TEXT], 50)[0])


@_query(f"with {_search_sql([FILE_TEXT], 20, 'src3')} select {_TOP} from top")
def search_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_search(spark, sf_dir, [FILE_TEXT], 20, "src3")[0])


_COVERAGE_SQL = f"""with {_search_sql([TEXT, 'part', FILE_TEXT], 100)}, counts as (select query_no, count(*) as matched from fused group by 1),
over as (select query_no, match from found where place > {S.CANDIDATE_LIMIT} group by all), reasons as (
  select query_no, case match when 'symbol' then 1 when 'edge' then 2 when 'file_fts' then 3 else 4 end as no,
    case match when 'symbol' then 'symbol candidates truncated' when 'edge' then 'edge candidates truncated'
      when 'file_fts' then 'full-text file candidates truncated' else 'substring file candidates truncated' end as reason from over
  union all select query_no, 5, 'search result limit reached' from counts where matched > 100
), told as (select query_no, string_agg(reason, '; ' order by no) as reasons from reasons group by 1)
select query_no, reasons is null as complete, reasons is not null as truncated, coalesce(reasons, '') as reasons,
  cast(least(coalesce(matched, 0), 100) as bigint) as returned, cast(coalesce(matched, 0) as bigint) as matched
from asked left join counts using (query_no) left join told using (query_no)"""


@_query(_COVERAGE_SQL)
def search_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    coverage = _search(spark, sf_dir, [TEXT, "part", FILE_TEXT], 100)[1]
    return coverage.select("query_no", "complete", "truncated", F.array_join("reasons", "; ").alias("reasons"), "returned", "matched")


@_query(
    f"with {_search_sql(['part'], 10)} select match, count(*) filter (where place <= 1000) as kept, max(case when place > 1000 then 1 else 0 end) as cut, "
    "min(score) filter (where place <= 1000) as least_score from found where place <= 1001 group by match"
)
def search_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.candidates(B.catalog(spark, sf_dir), S.queries_frame(spark, ["part"]))
    return found.groupBy("match").agg(
        F.count_if(F.col("place") <= 1000).alias("kept"), F.max(F.when(F.col("place") > 1000, 1).otherwise(0)).alias("cut"),
        F.min(F.when(F.col("place") <= 1000, F.col("score"))).alias("least_score"),
    )


@_query(
    f"with {B.FILES_SQL}, {_asked_sql(_ASKED['search_substring'])} select query_no, repository_id as repository, path as file, cast({_LINE_SQL} as int) as line "
    "from files, asked where contains(lower(content), lower(text))"
)
def search_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`%` and `_` are text like any other."""
    found = S.substring_candidates(S.scan_files(B.files(spark, sf_dir), S.queries_frame(spark, _ASKED["search_substring"])))
    return found.select("query_no", "repository", "file", "line")


@_query(f"with {B.FILES_SQL}, {_asked_sql(_ASKED['search_fts'])}, {_FTS_SQL} select query_no, repository_id as repository, path as file, round(rank, 6) as rank from ranks")
def search_fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = S.scan_files(B.files(spark, sf_dir), S.queries_frame(spark, _ASKED["search_fts"]))
    scan = replace(scan, rows=stage(scan.rows, "scan"))
    ranks = S.full_text_ranks(scan)
    return ranks.select("query_no", F.col("repository_id").alias("repository"), F.col("path").alias("file"), F.round("rank", 6).alias("rank"))


@_query(
    f"with {B.CATALOG_SQL}, {_asked_sql(_ASKED['search_symbols'])} select query_no, uid as id, name, cast({_score_sql('name', fn.SYMBOL_SCORES)} as double) as score "
    f"from symbols, asked where {_has_terms('name')}"
)
def search_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.symbol_candidates(B.catalog(spark, sf_dir).symbols, S.queries_frame(spark, _ASKED["search_symbols"]))
    return found.select("query_no", "id", "name", "score")


@_query(
    f"with {B.CATALOG_SQL}, {_asked_sql(['order.o7', 'part.p1'])} select query_no, repository_id as repository, source, target, cast(line as int) as line, "
    f"cast(greatest({_score_sql('source', fn.EDGE_SCORES)}, {_score_sql('target', fn.EDGE_SCORES)}) as double) as score from edges, asked where {_has_terms(chr(40) + 'source || chr(32) || target' + chr(41))}"
)
def search_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.edge_candidates(B.catalog(spark, sf_dir).edges, S.queries_frame(spark, ["order.o7", "part.p1"]))
    return found.select("query_no", "repository", "source", "target", "line", "score")


@_query(
    f"with {B.CATALOG_SQL} select repository_id as repository, path as file, cast(line as int) as line, name, kind, '' as source from symbols where repository_id in ('Brand#2', 'A') "
    "union all select repository_id, path, cast(line as int), target, kind, source from edges where repository_id = 'A' and path = 'line/F'"
)
def file_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.catalog(spark, sf_dir)
    wanted = found.symbols.filter("repository_id = 'Brand#2'").select("repository_id", "path")
    wanted = wanted.unionByName(spark.createDataFrame([("A", "line/F")], "repository_id string, path string"))
    return S.file_evidence(found.symbols, found.edges, wanted).select("repository", "file", "line", "name", "kind", "source")


def queries() -> dict:
    from . import graph_queries, index_queries, other_queries  # noqa: F401  they add theirs

    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
