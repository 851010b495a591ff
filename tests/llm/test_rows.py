"""Rows without an id, ids with several texts, repeated rows, names that operators use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodeweave.llm import byte_bpe, chat_format, decontaminate, exact_dedup, line_dedup, lm_score, ngram_join, substring_dedup, toxicity
from tests.llm.test_small import RANKS

import public_tokenizers

CLASHES = "row doc version n lines dropped toxicity _lines _dropped _toxicity _slots _template slots drops texts host n_words n_hit hit_spans hit_items rep key1 batch digest content decoded own_n_hit".split()


def long_text(seed, n=60):
    return " ".join(f"u{(seed * 7919 + i * 104729) % 4001}" for i in range(n))


BASE = long_text(1)
NEAR = BASE.replace(BASE.split()[30], "changed")
ROWS = [(None, BASE), (None, NEAR), (1, long_text(2)), (1, BASE + " tail"), (2, long_text(3)), (2, long_text(3)), (None, long_text(4)), (3, None), (4, "")]


def table(spark, rows=ROWS):
    """Every clashing column holds its own name and the row's number."""
    names = [c for c in CLASHES]
    data = [(i, t, *[f"{c}{k}" for c in names]) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, f"doc_id long, text string, {', '.join(c + ' string' for c in names)}")


def kept_values(df, but=()):
    """Whether each row that is left has the values it came with."""
    for r in df.collect():
        numbers = {r[c].removeprefix(c) for c in CLASHES if c in df.columns and c not in but}
        if len(numbers) != 1:
            return False
    return True


def test_ngram_join(spark):
    got = sorted(((r["doc"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(table(spark), k=3, num=90).collect()), key=repr)
    size = {t: len({tuple((t or "").split()[i : i + 3]) for i in range(len((t or "").split()) - 2)}) for _, t in ROWS}
    want = [(None, size[BASE], 1), (None, size[NEAR], 1), (1, size[ROWS[2][1]], 1), (1, size[BASE + " tail"], 1), (2, size[ROWS[4][1]], 2), (2, size[ROWS[4][1]], 2), (None, size[ROWS[6][1]], None), (3, 0, 3), (4, 0, 4)]
    assert got == sorted(want, key=repr)


def test_substring_dedup(spark):
    got = substring_dedup.repeated_paragraphs(table(spark)).collect()
    # The paragraphs of the three alike, one of them of an id that has another text, too; those of one repeated row are one.
    assert sorted(((r["doc"], r["keep_doc"], r["removed"]) for r in got), key=repr) == [(1, 1, False), (None, 1, True), (None, 1, True)]
    # The same words as passages: of the first of them in id, found in both rows without one; the two equal rows of id 2 are one document.
    assert {(r["doc"], r["keep_doc"]) for r in substring_dedup.repeated_passages(table(spark)).collect()} == {(None, 1)}
    out = substring_dedup.dedup_paragraphs(table(spark))
    assert out.count() == len(ROWS) and kept_values(out)


@pytest.mark.parametrize("where", ["inside", "across"])
def test_passages(spark, where):
    """A passage inside longer lines, or over short ones, is found from WINDOW + REACH + 3 words on."""
    shared = long_text(9, 51).split()
    own = lambda s: long_text(s, 70)
    passage = " ".join(shared) if where == "inside" else "\n".join(" ".join(shared[i : i + 7]) for i in range(0, 51, 7))
    rows = [(5, f"{own(11)} {passage} {own(12)}"), (6, f"{own(13)} {passage.upper()} {own(14)}"), (7, own(15)), (8, own(16) + " " + own(17))]
    got = substring_dedup.repeated_passages(table(spark, rows)).collect()
    assert [(r["doc"], r["keep_doc"]) for r in got] == [(6, 5)]
    assert got[0]["start"] >= 70 and got[0]["stop"] <= 121 and got[0]["stop"] - got[0]["start"] >= substring_dedup.WINDOW
    assert substring_dedup.repeated_passages(table(spark, []).limit(0)).count() == 0


def test_values_pass_through(spark):
    docs = table(spark)
    assert kept_values(exact_dedup.exact_dedup(docs)) and exact_dedup.exact_dedup(docs).count() == 7
    assert kept_values(line_dedup.dedup_lines(docs))
    model = toxicity.fit(docs, spark.createDataFrame([(1, 1), (None, 1)], "doc_id long, toxic int"))
    assert kept_values(toxicity.score(docs, model)) and toxicity.score(docs, model).count() == len(ROWS)
    assert toxicity.score(docs.limit(0), model).count() == 0
    items = spark.createDataFrame([("i", BASE)], "item_id string, text string")
    found = decontaminate.find_items(docs, items)
    assert kept_values(found, decontaminate.MADE) and found.filter("n_hit > 0").count() == 3
    assert decontaminate.find_items(docs.unionByName(docs), items).filter("n_hit > 0").count() == 6
    coded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert kept_values(coded) and coded.count() == len(ROWS)
    scored = lm_score.score_texts(docs).collect()
    assert len(scored) == len(ROWS) and sum(r["doc"] is None for r in scored) == 3


def test_chats_of_many_turns(spark):
    said = [(1, t, ("user", "assistant")[t % 2], f"turn {t} </s>") for t in range(1500)] + [(None, 0, "user", "a"), (None, 0, "user", "a")]
    rows = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(c) for c in ("conv", "turns", "pieces", "t")})
    back = {r["conv"]: r for r in chat_format.read_back(chat_format.format_chats(rows)).collect()}
    assert [t["text"] for t in back[1]["turns"]] == [s[3] for s in said[:1500]]
    assert back[1]["loss_text"] == "".join(s[3] for s in said[:1500] if s[2] == "assistant") and len(back[None]["turns"]) == 2


def test_stages_keep_columns(spark, tmp_path):
    """Each stage of the pipeline on a table with clashing names, ids that are null or have several texts, and nothing at all."""
    spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("i", long_text(4))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert kept_values(out, () if stage is not corpus_pipeline.as_tokens else ("ids",)), name
        if stage is not corpus_pipeline.as_tokens:
            assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    texts = lambda stage: sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs, str(tmp_path)).collect()), key=repr)
    # Of the three alike that with an id stays; the other text of its id stays, and the rows without an id that are like no other.
    assert texts(corpus_pipeline.one_of_each_group) == sorted([(1, long_text(2)), (1, BASE + " tail"), (2, long_text(3)), (2, long_text(3)), (None, long_text(4)), (3, None), (4, "")], key=repr)
    assert (None, long_text(4)) not in texts(corpus_pipeline.without_benchmark)
