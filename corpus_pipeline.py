"""The corpus pipeline: stages over `documents`, each written as Parquet and read again.

toxicity -> line dedup -> n-gram Jaccard join -> benchmark decontamination -> byte-level BPE.

Every stage works on all documents that the one before kept. All but the last
return the columns of documents; n_chars follows the text. The last returns the
ids of each text, packed, and digests of them and of the decoded bytes.

In every stage a null text counts as empty, a row without an id as the last
document, and repeated rows of an id as that document; columns of any other name
pass through with their values, in the last stage but for those it makes. An
empty table gives an empty table. What a stage keeps on disk goes when its
result is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import byte_bpe, decontaminate, line_dedup, ngram_join, toxicity
from lodeweave.llm.common import Workspace, scratch, unused


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; labels of held-out rows are not learnt from.

    Empty texts have no votes and stay; without usable labels the fixed lexicon decides.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~toxicity.held_out())
    rate = unused("toxicity", docs)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), score_col=rate)
    return scored.filter(F.col(rate) < 0.5).drop(rate)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; one that loses all of its text stays, empty."""
    made = [unused(name, docs) for name in ("lines", "dropped")]
    kept = line_dedup.dedup_lines(docs, lines_col=made[0], dropped_col=made[1]).drop(*made)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*[f"`{c}`" for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar sets of 5-word shingles (0.8 or more) the one of the smallest id.

    Empty texts are linked with nothing and stay. A group without any id keeps its rows without one.
    """
    groups = ngram_join.similar_groups(docs.select("doc_id", "text"))
    first = groups.filter("doc <=> component_id").select(F.struct("doc", "version").alias("first")).distinct()
    version = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col("first.doc")) & (version == F.col("first.version")), "left_semi")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    own = {c: unused(f"own_{c}", docs) for c in docs.columns if c in decontaminate.MADE}
    found = decontaminate.find_items(docs.withColumnsRenamed(own), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    clean = found.filter(~decontaminate.contaminated())
    return clean.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with digests of the ids and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    others = [c for c in docs.columns if c not in ("text", *made)]
    decoded = unused("decoded", docs)
    coded = byte_bpe.encode(docs.select(*[f"`{c}`" for c in others], "text"), path, public_tokenizers.PATTERN, decoded_col=decoded)
    return coded.select(
        *[f"`{c}`" for c in others],
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", as_tokens),
]

#: The classifier of the first stage cannot be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        with scratch():
            docs = space.stage(stage(spark, docs, sf_dir), str(number))
        if number:
            space.drop(str(number - 1))
    return docs
