"""Queries through the stored index: built from the tables, changed as a refresh changes it, then searched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bindings as B
from .operators import search as S
from .operators.text_index import TextIndex
from .queries import FILE_TEXT, TEXT, _ASKED, _SQL, _TOP, _query, _search_sql, _shown
from .schemas import Evidence
from .staging import working_path


def indexed(spark: SparkSession, found: Evidence) -> S.Indexed:
    """An index that has come to these files and symbols in three steps: first as most of them were before, then what changed, then what was added."""
    index = TextIndex(spark, working_path(spark, "index"), fanout=3)
    turn = F.pmod(F.xxhash64("path"), F.lit(4))
    files, symbols = (x.withColumn("turn", turn) for x in (found.files, found.symbols))
    # Before: a quarter is not there yet, a quarter has another text, and some files are there that go.
    old = files.filter("turn < 3").withColumn("content", F.when(F.col("turn") == 2, F.concat(F.lit("the thing before "), F.reverse("content"))).otherwise(F.col("content")))
    gone = files.filter("turn = 0").withColumn("path", F.concat(F.lit("gone/"), "path"))
    state = index.add([], old.unionByName(gone), symbols.filter("turn < 3").withColumn("name", F.when(F.col("turn") == 2, F.concat(F.lit("Old"), "name")).otherwise(F.col("name"))))
    touched = [x.select("repository_id", "path") for x in (files.filter("turn = 2"), gone, symbols.filter("turn = 2"))]
    state = index.add(state, files.filter("turn = 2"), symbols.filter("turn = 2"), touched[0].unionByName(touched[1]).unionByName(touched[2]))
    state = index.add(state, files.filter("turn = 3"), symbols.filter("turn = 3"))
    return S.Indexed(index, state, found.files)


@_query(_SQL["search_fts"])
def index_search_fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = indexed(spark, B.catalog(spark, sf_dir))
    ranks = S.indexed_ranks(stored, S.asked_terms(S.queries_frame(spark, _ASKED["search_fts"])))
    return ranks.select("query_no", F.col("repository_id").alias("repository"), F.col("path").alias("file"), F.round("rank", 6).alias("rank"))


@_query(_SQL["search_substring"])
def index_search_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = indexed(spark, B.catalog(spark, sf_dir))
    found = S.indexed_texts(stored, S.asked_terms(S.queries_frame(spark, _ASKED["search_substring"])))
    return found.select("query_no", F.col("repository_id").alias("repository"), F.col("path").alias("file"), "line")


@_query(_SQL["search_symbols"])
def index_search_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.catalog(spark, sf_dir)
    symbols = S.indexed_symbols(indexed(spark, found), found.symbols, S.queries_frame(spark, _ASKED["search_symbols"]))
    return symbols.select("query_no", "id", "name", "score")


@_query(f"with {_search_sql([TEXT, FILE_TEXT], 50)} select {_TOP} from top")
def index_search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.catalog(spark, sf_dir)
    return _shown(S.ranked_search(found, S.queries_frame(spark, [TEXT, FILE_TEXT]), limit=50, stored=indexed(spark, found))[0])
