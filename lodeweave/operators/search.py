"""Ranked search: symbol, edge, full-text and substring candidates, fused and ranked.

All functions take a table of queries (query_no, text), so that the keywords of
a requirement are one job. The table is small by contract (MOST_QUERIES).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as fn
from ..schemas import Evidence
from ..staging import stage
from .ranking import top_per_key
from .text_index import TextIndex, file_words, triples

DEFAULT_LIMIT = 1000
CANDIDATE_LIMIT = 1000
MOST_QUERIES = 64
K1, B = 1.2, 0.75

_COLUMNS = ["query_no", "repository", "file", "line", "name", "kind", "confidence", "id", "signature", "end_line", "source", "target"]
_KEY = ["query_no", "repository", "file", "line", "name", "kind", "source", "target"]


def queries_frame(spark: SparkSession, texts: list[str]) -> DataFrame:
    if len(texts) > MOST_QUERIES:
        raise ValueError(f"at most {MOST_QUERIES} queries at a time")
    return spark.createDataFrame(list(enumerate(texts)), "query_no int, text string")


def _prepared(queries: DataFrame) -> DataFrame:
    text = F.trim("text")
    return F.broadcast(
        queries.select(
            "query_no", text.alias("text"), fn.normalize_identifier(text).alias("query"), fn.identifier_terms(text).alias("terms")
        )
    )


def _evidence(df: DataFrame, **given) -> DataFrame:
    made = {"id": F.lit(""), "signature": F.lit(""), "end_line": F.lit(0), "source": F.lit(""), "target": F.lit("")} | given
    return df.select(*[made[c].alias(c) if c in made else F.col(c) for c in _COLUMNS], "score", "reason", "tier", "match")


def _reason(name, exact: str, normal: str, other: str, scores):
    return F.when(F.col("score") == scores[0], exact).when(F.col("score") == scores[1], normal).otherwise(other)


def symbol_candidates(symbols: DataFrame, queries: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Symbols whose names have every term of a query. pairs: (query_no, uid) that can; only these are looked at."""
    prepared, named = _prepared(queries), fn.all_terms_in(F.col("name"), F.col("terms"))
    met = symbols.join(prepared, named) if pairs is None else symbols.join(pairs, "uid").join(prepared, "query_no").filter(named)
    met = met.withColumn("score", fn.name_score(F.col("name"), F.col("text"), F.col("query"), fn.SYMBOL_SCORES))
    plain = F.translate(F.lower("name"), "_-.", "")
    tier = F.when(fn.same_text(F.col("name"), F.col("text")), 0).when(F.endswith(plain, F.col("query")), 1).otherwise(2)
    reason = _reason("name", "exact symbol match", "exact normalized identifier match", "symbol identifier match", fn.SYMBOL_SCORES)
    return _evidence(
        met.withColumns({"tier": tier, "reason": reason, "match": F.lit("symbol")}),
        repository=F.col("repository_id"), file=F.col("path"), confidence=F.lit("certain"), id=F.col("uid"),
        signature=F.col("signature"), end_line=F.col("end_line"),
    )


def edge_candidates(edges: DataFrame, queries: DataFrame, most: int | None = None) -> DataFrame:
    """Relations whose ends have every term of a query; most: of each query only the first so many, which alone are scored."""
    prepared = _prepared(queries)
    lowered = F.lower(F.concat_ws(" ", "source", "target"))
    # At most MOST_QUERIES short texts: as values of the plan they are compared in the scan, where a join would test rows one by one.
    asked = [(r["query_no"], r["terms"]) for r in prepared.select("query_no", "terms").collect() if r["terms"]]
    having = [F.when(reduce(and_, [F.contains("_both", F.lit(t)) for t in terms]), F.lit(no)) for no, terms in asked]
    numbers = F.array_compact(F.array(*having)) if having else F.array().cast("array<int>")
    met = edges.withColumn("_both", lowered).withColumn("_asked", numbers).filter(F.size("_asked") > 0)
    met = met.withColumn("query_no", F.explode("_asked")).drop("_both", "_asked")
    if most is not None:
        met = met.select("query_no", "repository_id", "path", "source", "target", "kind", "line", "confidence").join(prepared.select("query_no", F.lower("text").alias("_text")), "query_no")
        met = met.withColumn("_tier", F.when((F.lower("source") == F.col("_text")) | (F.lower("target") == F.col("_text")), 0).otherwise(1)).drop("_text")
        met = top_per_key(met, ["query_no"], [F.col(c) for c in ("_tier", "repository_id", "path", "line", "target", "source")], most, "_place").drop("_place", "_tier")
    met = met.join(prepared, "query_no")
    score = lambda c: fn.name_score(F.col(c), F.col("text"), F.col("query"), fn.EDGE_SCORES)
    met = met.withColumn("score", F.greatest(score("source"), score("target")))
    exact = fn.same_text(F.col("source"), F.col("text")) | fn.same_text(F.col("target"), F.col("text"))
    reason = _reason("name", "exact edge endpoint match", "exact normalized edge endpoint match", "edge endpoint match", fn.EDGE_SCORES)
    return _evidence(
        met.withColumns({"tier": F.when(exact, 0).otherwise(1), "reason": reason, "match": F.lit("edge")}),
        repository=F.col("repository_id"), file=F.col("path"), name=F.col("target"), source=F.col("source"), target=F.col("target"),
    )


@dataclass(frozen=True)
class FileScan:
    """What one reading of the files says about all queries: rows without any text.

    rows: (repository_id, path, length, hits array of the queries' terms, literal array<struct<query_no, line>>).
    """

    rows: DataFrame
    queries: DataFrame

    def within(self, repository: str | None) -> DataFrame:
        return self.rows.filter(F.col("repository_id") == repository) if repository else self.rows


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_no, text, lowered, terms): the queries with their terms as full-text search has them."""
    prepared = _prepared(queries).select("query_no", "text", F.lower("text"), F.transform("terms", fn.without_marks))
    # At most MOST_QUERIES short texts; they go to the executors with the plan.
    return queries.sparkSession.createDataFrame([tuple(r) for r in prepared.collect()], "query_no int, text string, lowered string, terms array<string>")


def scan_files(files: DataFrame, queries: DataFrame) -> FileScan:
    """Reads each file once: its number of tokens, its tokens that are terms of a query, the queries it has word for word."""
    asked = asked_terms(queries)
    rows = asked.collect()
    vocabulary = sorted({t for r in rows for t in r["terms"]})
    words = file_words()
    hits = F.filter("words", lambda w: w.isin(*vocabulary)) if vocabulary else F.array().cast("array<string>")
    lowered = F.lower("content")
    place = [F.when(F.contains(lowered, F.lower(F.lit(r["text"]))), F.struct(F.lit(r["query_no"]).alias("query_no"), fn.match_line(F.col("content"), F.lit(r["text"])).alias("line"))) for r in rows]
    literal = F.array_compact(F.array(*place)) if place else F.array().cast("array<struct<query_no:int,line:int>>")
    scanned = files.select("repository_id", "path", words.alias("words"), literal.alias("literal"))
    return FileScan(scanned.select("repository_id", "path", F.size("words").alias("length"), hits.alias("hits"), "literal"), asked)


@dataclass(frozen=True)
class Indexed:
    """A stored index, one of its states, and the files and symbols it is of."""

    index: TextIndex
    state: list[dict]
    files: DataFrame


def _ranks(asked: DataFrame, postings: DataFrame, seen: DataFrame, totals: DataFrame, more: list[str]) -> DataFrame:
    """BM25 of files that have every term of a query; seen: (term, df), totals: one row (n, average)."""
    wanted = asked.select("query_no", F.explode(F.array_distinct("terms")).alias("term"))
    weighed = postings.join(F.broadcast(seen), "term").crossJoin(F.broadcast(totals))  # as many rows as the queries have terms
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    scored = weighed.select("term", "repository_id", "path", *more, part.alias("part"))
    sized = wanted.join(wanted.groupBy("query_no").agg(F.count(F.lit(1)).alias("asked")), "query_no")
    return (
        scored.join(F.broadcast(sized), "term")
        .groupBy("query_no", "repository_id", "path", "asked")
        .agg(F.count(F.lit(1)).alias("had"), (-F.sum("part")).alias("rank"), *[F.any_value(c).alias(c) for c in more])
        .filter("had = asked")
        .select("query_no", "repository_id", "path", "rank", *more)
    )


def full_text_ranks(scan: FileScan, repository: str | None = None) -> DataFrame:
    """(query_no, repository_id, path, rank, literal) of files that have every term; rank is minus BM25, lower is better.

    Numbers of files and of tokens are those of all files scanned, also for a search in one repository.
    """
    totals = scan.rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"))
    seen = scan.rows.select(F.explode(F.array_distinct("hits")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    postings = scan.within(repository).filter(F.size("hits") > 0)
    postings = postings.select("repository_id", "path", "length", "literal", "hits", F.explode(F.array_distinct("hits")).alias("term"))
    postings = postings.withColumn("tf", F.size(F.filter("hits", lambda h: h == F.col("term")))).drop("hits")
    return _ranks(scan.queries, postings, seen, totals, ["literal"])


def indexed_ranks(stored: Indexed, asked: DataFrame, repository: str | None = None) -> DataFrame:
    """full_text_ranks() from the stored postings of the queries' terms; no text is read."""
    n, tokens = stored.index.totals(stored.state)
    totals = asked.sparkSession.createDataFrame([(n, tokens / n if n else 0.0)], "n long, average double")
    postings = stored.index.postings(stored.state, sorted({t for r in asked.select("terms").collect() for t in r["terms"]}))
    seen = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return _ranks(asked, postings.filter(F.col("repository_id") == repository) if repository else postings, seen, totals, [])


def indexed_texts(stored: Indexed, asked: DataFrame, repository: str | None = None) -> DataFrame:
    """(query_no, repository_id, path, line) of files with a query's text word for word, whatever its case.

    Texts are read of those files only that have all byte triples of the text; of all files for a text without any.
    """
    files = stored.files.filter(F.col("repository_id") == repository) if repository else stored.files
    rows = asked.collect()
    grams = {r["query_no"]: triples(r["lowered"].encode()) for r in rows}
    short = [q for q, g in grams.items() if not g]
    texts = asked.select("query_no", "text", "lowered")
    found = None
    if len(short) < len(grams):
        able = stored.index.having(stored.state, {q: g for q, g in grams.items() if g})
        found = files.join(able, ["repository_id", "path"]).join(F.broadcast(texts), "query_no").filter(F.contains(F.lower("content"), F.col("lowered")))
    if short:
        every = files.join(F.broadcast(texts.filter(F.col("query_no").isin(*short))), F.contains(F.lower("content"), F.col("lowered"))).select(*(found.columns if found else "*"))
        found = every if found is None else found.unionByName(every)
    if found is None:
        found = files.join(F.broadcast(texts), F.lit(False))
    return found.select("query_no", "repository_id", "path", fn.match_line(F.col("content"), F.col("text")).alias("line"), "text")


def indexed_symbols(stored: Indexed, symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """symbol_candidates() of the symbols whose names have all byte triples of a query's terms."""
    terms = {r["query_no"]: r["terms"] for r in _prepared(queries).select("query_no", "terms").collect()}
    grams = {q: set().union(*(triples(t.encode()) for t in ts)) for q, ts in terms.items() if ts}
    short = [q for q, g in grams.items() if not g]
    long = {q: g for q, g in grams.items() if g}
    able = stored.index.having(stored.state, long, "symbol_grams").select("query_no", "uid") if long else None
    found = symbol_candidates(symbols, queries, able) if long else None
    if short or not long:
        every = symbol_candidates(symbols, queries.filter(F.col("query_no").isin(*short)))
        found = every if found is None else found.unionByName(every)
    return found


def _file_evidence(df: DataFrame) -> DataFrame:
    return _evidence(df, repository=F.col("repository_id"), file=F.col("path"), name=F.col("text"), kind=F.lit("text"), confidence=F.lit("certain"))


def full_text_candidates(scan: FileScan, repository: str | None = None) -> DataFrame:
    met = full_text_ranks(scan, repository).join(F.broadcast(scan.queries.select("query_no", "text")), "query_no")
    mine = F.filter("literal", lambda x: x.query_no == F.col("query_no"))
    line = F.coalesce(F.get(mine, F.lit(0)).line, F.lit(1))
    made = {"line": line, "score": fn.full_text_score(F.col("rank")), "reason": F.lit("full-text file match"), "tier": F.col("rank"), "match": F.lit("file_fts")}
    return _file_evidence(met.withColumns(made))


def substring_candidates(scan: FileScan, repository: str | None = None) -> DataFrame:
    met = scan.within(repository).select("repository_id", "path", F.inline("literal")).join(F.broadcast(scan.queries.select("query_no", "text")), "query_no")
    made = {"score": F.lit(fn.SUBSTRING_SCORE), "reason": F.lit("literal file-content match"), "tier": F.lit(0), "match": F.lit("file_substring")}
    return _file_evidence(met.withColumns(made))


def indexed_file_candidates(stored: Indexed, queries: DataFrame, most: int, repository: str | None = None) -> list[DataFrame]:
    """Full-text and literal candidates of files; of the full-text ones the first `most`, whose texts alone are read."""
    asked = asked_terms(queries)
    texts = F.broadcast(asked.select("query_no", "text"))
    ranks = top_per_key(indexed_ranks(stored, asked, repository), ["query_no"], [F.col("rank"), F.col("repository_id"), F.col("path")], most).drop("rank_no")
    met = stored.files.select("repository_id", "path", "content").join(ranks, ["repository_id", "path"]).join(texts, "query_no")
    ranked = {"line": fn.match_line(F.col("content"), F.col("text")), "score": fn.full_text_score(F.col("rank")), "reason": F.lit("full-text file match"), "tier": F.col("rank"), "match": F.lit("file_fts")}
    literal = {"score": F.lit(fn.SUBSTRING_SCORE), "reason": F.lit("literal file-content match"), "tier": F.lit(0), "match": F.lit("file_substring")}
    return [_file_evidence(met.withColumns(ranked)), _file_evidence(indexed_texts(stored, asked, repository).withColumns(literal))]


_GAPS = {
    "symbol": "symbol candidates truncated",
    "edge": "edge candidates truncated",
    "file_fts": "full-text file candidates truncated",
    "file_substring": "substring file candidates truncated",
}


def candidates(
    found: Evidence, queries: DataFrame, candidate_limit: int = CANDIDATE_LIMIT, repository: str | None = None, stored: Indexed | None = None
) -> DataFrame:
    """Candidates of the four sources, each cut to candidate_limit + 1, exact ones first; `place` is the rank there.

    With a stored index only postings and the texts of candidates are read. Without, the files are scanned once; the
    scan is read for totals, document frequencies and hits: its rows, which have no text, are stored.
    """
    mine = found.within(repository) if repository else found
    if stored:
        symbols = indexed_symbols(stored, mine.symbols, queries)
        texts = indexed_file_candidates(stored, queries, candidate_limit + 1, repository)
    else:
        scan = scan_files(found.files, queries)
        scan = replace(scan, rows=stage(scan.rows, "scan"))
        symbols = symbol_candidates(mine.symbols, queries)
        texts = [full_text_candidates(scan, repository), substring_candidates(scan, repository)]
    parts = [symbols, edge_candidates(mine.edges, queries, candidate_limit + 1), *texts]
    order = [F.col("tier"), F.col("repository"), F.col("file"), F.col("line"), F.col("name"), F.col("source")]
    union = None
    for part in parts:
        part = part.withColumn("tier", F.col("tier").cast("double"))
        top = top_per_key(part, ["query_no"], order, candidate_limit + 1, "place")
        union = top if union is None else union.unionByName(top)
    return union


def fuse(found: DataFrame, candidate_limit: int = CANDIDATE_LIMIT) -> DataFrame:
    """One row per evidence: the highest score with its reason, all sources."""
    kept = found.filter(F.col("place") <= candidate_limit)
    return kept.groupBy(*_KEY).agg(
        F.max("score").alias("score"),
        F.max_by("reason", F.struct("score", F.expr("case match when 'symbol' then 4 when 'edge' then 3 when 'file_fts' then 2 else 1 end"))).alias("reason"),
        F.array_sort(F.collect_set("match")).alias("match_sources"),
        *[F.max(c).alias(c) for c in ("confidence", "id", "signature", "end_line")],
    )


RANK_ORDER = ["repository", "file", "line", "kind", "name", "source", "target"]


def ranked_search(
    found: Evidence, queries: DataFrame, repository: str | None = None, limit: int = DEFAULT_LIMIT, candidate_limit: int = CANDIDATE_LIMIT,
    stored: Indexed | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(evidence with rank_no, coverage), both by query_no."""
    if not 1 <= limit <= DEFAULT_LIMIT:
        raise ValueError(f"search limit must be between 1 and {DEFAULT_LIMIT}")
    if repository:
        check_scope(found, repository)
    all_candidates = candidates(found, queries, candidate_limit, repository, stored)
    fused = fuse(all_candidates, candidate_limit)
    order = [F.col("score").desc(), *[F.col(c) for c in RANK_ORDER]]
    top = top_per_key(fused, ["query_no"], order, limit)
    return top, _coverage(all_candidates, fused, queries, limit, candidate_limit)


def _coverage(found: DataFrame, fused: DataFrame, queries: DataFrame, limit: int, candidate_limit: int) -> DataFrame:
    over = found.groupBy("query_no").agg(
        *[F.max((F.col("match") == m) & (F.col("place") > candidate_limit)).alias(m) for m in _GAPS]
    )
    counts = fused.groupBy("query_no").agg(F.count(F.lit(1)).alias("matched"))
    joined = queries.select("query_no").join(over, "query_no", "left").join(counts, "query_no", "left")
    matched = F.coalesce("matched", F.lit(0))
    reasons = [F.when(F.col(m), F.lit(text)) for m, text in _GAPS.items()]
    reasons.append(F.when(matched > limit, F.lit("search result limit reached")))
    joined = joined.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return joined.select(
        "query_no",
        (F.size("reasons") == 0).alias("complete"),
        (F.size("reasons") > 0).alias("truncated"),
        "reasons",
        F.lit(0).cast("long").alias("unresolved"),
        F.lit(0).cast("long").alias("diagnostics"),
        F.lit(limit).cast("long").alias("limit"),
        F.least(matched, F.lit(limit)).cast("long").alias("returned"),
        matched.cast("long").alias("matched"),
    )


def check_scope(found: Evidence, repository: str) -> None:
    """A repository that no table knows is an error, not an empty result."""
    for table in (found.files, found.symbols, found.edges):
        if not table.filter(F.col("repository_id") == repository).limit(1).isEmpty():
            return
    raise ValueError(f"repository scope not found: {repository}")


def file_evidence(symbols: DataFrame, edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Symbols and edges of files (repository_id, path), of all files without any."""
    mine = symbols.select(
        F.col("repository_id").alias("repository"), F.col("path").alias("file"), "line", "name", "kind", F.lit("certain").alias("confidence"),
        F.col("uid").alias("id"), "signature", "end_line", F.lit("").alias("source"), F.lit("").alias("target"),
    )
    theirs = edges.select(
        F.col("repository_id").alias("repository"), F.col("path").alias("file"), "line", F.col("target").alias("name"), "kind", "confidence",
        F.lit("").alias("id"), F.lit("").alias("signature"), F.lit(0).alias("end_line"), "source", "target",
    )
    out = mine.unionByName(theirs)
    if files is None:
        return out
    wanted = files.select(F.col("repository_id").alias("repository"), F.col("path").alias("file")).distinct()
    return out.join(wanted, ["repository", "file"], "left_semi")
