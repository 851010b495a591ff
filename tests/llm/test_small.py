"""Operators on small tables: plain versions, nulls, empty and repeated rows, empty tables, clashing names."""

import collections
import hashlib
import math
import random
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lodeweave.llm import byte_bpe, chat_format, decontaminate, exact_dedup, html_extract, line_dedup, lm_score, ngram_join, substring_dedup, toxicity
from lodeweave.llm.common import Workspace
from lodeweave.llm.components import components
from tests.conftest import SF

DOCS = "doc_id long, text string, row string, doc long, version long, n int, bands string, score string"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def docs(spark, texts):
    """A table with nulls, repeats and names that operators use themselves."""
    return spark.createDataFrame([(i, t, "row", 7, 8, 9, "b", "s") for i, t in texts], DOCS)


def odd_texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = " ".join(rng.choice(words) for _ in range(120))
    rows = [(1, base), (2, base.upper()), (3, base + " tail"), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (7, "one two"), (None, "one two"), (8, base.replace("w1", "x1", 1))]
    rows += [(10 + i, " ".join(rng.choice(words) for _ in range(60))) for i in range(12)]
    return [*rows, (40, rows[10][1]), (41, "\n".join([rows[11][1], base]))]


def text_of(t):
    return (t or "").encode()


def test_line_dedup(spark):
    long = "x" * 200_000
    rows = [(2, "Shared line here\nshort\nown of two"), (1, " shared LINE here \nshort\n"), (3, None), (4, ""), (2, "Shared line here\nshort\nown of two"), (5, f"{long}\nÉcole line ten"), (6, f"école line ten\n{long}"), (None, "shared line here")]
    got = line_dedup.dedup_lines(docs(spark, rows), batches=3, fanout=2)
    assert set(DOCS.replace(",", "").split()[::2]) <= set(got.columns)
    found = {(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()}
    assert found == {
        (2, "short\nown of two", 3, 1), (1, " shared LINE here \nshort\n", 3, 0), (3, "", 1, 0), (4, "", 1, 0),
        (5, f"{long}\nÉcole line ten", 2, 0), (6, "école line ten", 2, 1), (None, "", 1, 1),
    }
    assert got.count() == len(rows)
    assert line_dedup.dedup_lines(docs(spark, []).limit(0)).count() == 0


def test_exact_dedup(spark):
    rows = [(3, "a  b"), (1, "a\tb"), (2, None), (5, ""), (4, "c"), (4, "c"), (None, "a b")]
    found = {(r["doc"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs(spark, rows)).collect()}
    assert found == {(3, 1, 3, False), (1, 1, 3, True), (2, 2, 2, True), (5, 2, 2, False), (4, 4, 2, True), (None, 1, 3, False)}
    assert exact_dedup.exact_groups(docs(spark, []).limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in exact_dedup.exact_dedup(docs(spark, rows)).collect()) == [1, 2, 4]
    odd = [(None, "x"), (None, "x"), (None, "y"), (1, "a"), (1, "b"), (2, "b"), (0, "a")]
    kept = exact_dedup.exact_dedup(docs(spark, odd))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == [(0, "a"), (1, "b"), (None, "x"), (None, "y")]
    assert kept.columns == docs(spark, odd).columns and kept.first()["row"] == "row"


def test_cuckoo_index(spark):
    keys = np.random.default_rng(1).integers(0, 1 << 63, 3000, dtype=np.uint64)
    table = exact_dedup.CuckooFilter.sized(3000)
    assert table.insert(keys) and table.contains(keys).all()
    assert table.contains(keys + np.uint64(1)).mean() < 0.01
    assert not exact_dedup.CuckooFilter(2).insert(keys)
    index = exact_dedup.CuckooIndex(spark, Workspace(spark, "test"), 2000, first_sizing=2)
    rows = spark.range(600).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.col("id").alias("doc"), F.col("id").cast("string").alias("content"))
    later = rows.withColumn("doc", F.col("doc") + 1000)
    live = lambda: {(bytes(r["digest"]), r["doc"]) for r in index.stored().collect()}
    want = {(bytes(r["digest"]), r["doc"]) for r in rows.collect()}
    index.insert(later.filter("doc < 1300"))
    index.insert(rows)  # smaller documents take the place of the live ones
    index.insert(later)
    assert live() == want and index.filters.agg(F.sum("n_keys")).first()[0] == 600
    index.delete(rows.filter("doc < 100"))
    assert live() == {(d, n) for d, n in want if n >= 100}
    probed = index.probe(index.with_shard(rows).select("shard", "digest", "doc"))
    assert probed.filter("doc >= 100 and not maybe").count() == 0 and probed.filter("doc < 100 and maybe").count() < 10
    index.insert(rows.filter("doc < 50"))
    assert live() == {(d, n) for d, n in want if n >= 100 or n < 50}
    # A hit of another content is no copy: its digest would be that of two texts.
    index.insert(rows.filter("doc = 200").select("digest", F.lit(7).cast("long").alias("doc"), F.lit("other").alias("content")))
    assert {n for d, n in live() if d in {x for x, m in want if m == 200}} == {7, 200}
    index.drop()


def test_chat_format(spark):
    said = "</s>[INST] \\<|end|> ok <|next|>"
    rows = [(1, 2, "assistant", "b"), (1, 0, "user", said), (1, 1, "user", None), (1, 3, "assistant", said), (2, 0, None, "x"), (None, None, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(0))
    back = {r["conv"]: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("user", said), ("user", ""), ("assistant", "b"), ("assistant", said)]
    assert back[1]["loss_text"] == "b" + said and back[2]["loss_text"] == "" and back[2]["turns"][0]["role"] == "unknown"
    assert len(back) == 3 and chat_format.format_chats(df.limit(0)).count() == 0


def test_byte_bpe(spark):
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(RANKS).tokens)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    bits = [" ", "  ", "\n", "a", "aa", "the", "'s", "é", "漢字", "12", "\x85", "\xa0", "<|endoftext|>", "😀", "\x1c", "ing", "."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)] + [None, "", "ab" * 30_000]
    df = docs(spark, list(enumerate(texts)))
    got = byte_bpe.decode(byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == plain.encode_ordinary(texts[r["doc_id"]] or "")
        assert bytes(r["decoded"]) == text_of(texts[r["doc_id"]])
    assert byte_bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def similar(rows, k, share):
    """Components of documents by a plain comparison of all pairs."""
    sets = {}
    for i, t in rows:
        words = text_of(t).lower().split()
        sets[(1 << 63) - 1 if i is None else i] = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
    of = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                low, high = sorted((of[a], of[b]))
                of = {i: low if c == high else c for i, c in of.items()}
    return {i: (len(s), of[i]) for i, s in sets.items()}


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_ngram_join(spark, k, num):
    rows = odd_texts()
    got = ngram_join.similar_groups(docs(spark, rows), k=k, num=num)
    last = (1 << 63) - 1
    assert {last if r["doc"] is None else r["doc"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == similar(rows, k, num / 100)
    assert got.count() == len(rows)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.similar_groups(docs(spark, []).limit(0)).count() == 0
    assert [ngram_join.matches_asked(np.array(c), 2) for c in ([1.0, 1, 1, 1], [1.0, 1, 900, 900], [1.0, 1])] == [3, 1, 1]


def test_substring_dedup(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"v{rng.randrange(900)}" for _ in range(n))
    shared, other = text(60), text(50)
    near = shared.replace(shared.split()[30], "changed")
    rows = [(1, f"{text(40)}\n{shared}"), (2, f"{near}\n{text(30)}"), (3, f"short\n{shared}\n{shared}"), (4, other), (5, None), (6, ""), (3, f"short\n{shared}\n{shared}")]
    got = substring_dedup.repeated_paragraphs(docs(spark, rows))
    assert {(r["doc"], r["place"], r["keep_doc"], r["removed"]) for r in got.collect()} == {(1, 1, 1, False), (2, 0, 1, True), (3, 1, 1, True), (3, 2, 1, True)}
    kept = {r["doc_id"]: (r["text"], r["n_removed"]) for r in substring_dedup.dedup_paragraphs(docs(spark, rows)).collect()}
    assert kept[3] == ("short", 2) and kept[4] == (other, 0) and kept[5] == (None, 0)
    assert substring_dedup.repeated_paragraphs(docs(spark, []).limit(0)).count() == 0


def test_decontaminate(spark):
    item = " ".join(f"q{i}" for i in range(20))
    items = spark.createDataFrame([(1, item), (2, "just three words"), (3, None), (4, ""), (None, item), (1, item)], "item_id long, text string")
    rows = [(1, f"pad {item.upper()}, pad"), (2, " ".join(item.split()[:12])), (3, "x " * 200 + "Just-three. WORDS " + "y " * 200), (4, None), (5, " ".join(item.split()[3:16]))]
    for size in (8 << 20, 40):  # one block, and many
        found = decontaminate.find_items(docs(spark, rows), items, block_bytes=size).withColumn("bad", decontaminate.contaminated())
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["hit_items"], r["bad"]) for r in found.collect()} == {
            1: (22, 20, ["1"], True), 2: (12, 0, [], False), 3: (403, 3, ["2"], False), 4: (0, 0, [], False), 5: (13, 13, ["1"], True),
        }
    assert decontaminate.find_items(docs(spark, rows), items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_toxicity(spark):
    rng = random.Random(6)
    clean = lambda: " ".join(f"c{rng.randrange(300)}" for _ in range(40))
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 1
        rows.append((i, clean() + (f" grumb{rng.choice('aeiou')}{i % 7} " if bad else " ") + clean()))
        labels.append((i, int(bad), "x"))
    rows += [(1000, None), (1001, ""), (1002, "grumbzz " + clean()), (1003, "you idiot")]
    given = spark.createDataFrame([*labels, (5, None, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    table = docs(spark, rows)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(table, toxicity.fit(table, given.filter(~toxicity.held_out()))).collect()}
    wrong = sum((scored[i] >= 0.5) != bool(t) for i, t, _ in labels)
    assert wrong == 0 and scored[1000] == scored[1001] < 0.5 and scored[1002] >= 0.5
    model = toxicity.fit(table, given.limit(0))
    assert model.score(b"you idiot") > 0.5 > model.score(b"fine")


def test_label_model_shares_weight_of_correlated_voters():
    votes = np.array([[1.0, 1, 0], [1, 1, 1], [0, 0, 0], [0, 0, 1]])
    posterior, rates, correlation = toxicity.label_model(votes, np.array([1, 1, 0, 0]), np.array([30.0, 10, 200, 10]))
    assert (posterior.round() == [1, 1, 0, 0]).all() and correlation[0, 1] > 0.5 and (rates[1, :2] > rates[0, :2]).all()


def test_lm_score(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"t{(a := (a * 3 + rng.randrange(2)) % 40 if j else i % 40)}" for j in range(30))) for i in range(200) if (a := 0) is not None]
    rows += [(900, None), (901, ""), (902, "never Seen"), (903, "t1 t1"), (903, "t1 t1")]
    got = lm_score.score_texts(docs(spark, rows)).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*text_of(t).lower().split(), b" end"]
    counts = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    texts = dict(rows)
    assert len(got) == len(rows)
    gain = 0.0
    for r in got:
        words = tokens(texts[r["doc"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words))
        gain += (r["score"] - r["base_score"]) * held(r["doc"])
        assert r["score"] < 0
    assert gain > 0
    assert lm_score.score_texts(docs(spark, []).limit(0)).count() == 0


def lm(spark, texts):
    """A learnt model: log10 of the probability of each word after each context, from the tables of the parts."""
    learn = spark.createDataFrame([(t,) for t in texts], "text string")
    model = lm_score.learn(Workspace(spark, "lm-test"), learn, 4, 2)
    facts = model.words()
    words, chances, rooms = {}, {}, {}
    for r in facts.collect():
        for h, n, p, room in zip(lm_score.unpack_sorted(bytes(r["words"])).tolist(), *(lm_score.unpack(bytes(r[c]), np.float64).tolist() for c in ("tokens", "chances", "rooms"))):
            words[h], chances[h], rooms[h] = n, p, room
    gains = {}
    for r in model.gains(facts).collect():
        gains |= dict(zip(lm_score.unpack_sorted(bytes(r["keys"])).tolist(), lm_score.unpack(bytes(r["gains"]), np.float32).tolist()))

    def log(before, word):
        pair = int(lm_score.pair_keys(np.array([before], np.uint64), np.array([word], np.uint64))[0])
        return rooms.get(before, 0.0) + math.log10(chances.get(word, model.unknown)) + gains.get(pair, 0.0)

    return words, log


def test_lm_is_a_distribution(spark):
    """The next word's probabilities after any context, known or not, add up to one with that of an unknown word."""
    words, log = lm(spark, ["a b a c", "a b b", "c a b d", ""])
    assert sum(words.values()) == 15 and sum(n > 0 for n in words.values()) == 5  # the beginning is no token
    for before in [*words, 12345]:
        total = sum(10 ** log(before, w) for w, n in words.items() if n) + 10 ** log(before, 999)
        assert total == pytest.approx(1, abs=1e-6)


def plain_sampler(texts, held_out, strength, discount, sweeps=60, burn_in=20):
    """Mean log10 scores of held-out texts from seating one customer at a time, by the book."""
    rng = random.Random(5)
    tokens = [[*t.split(), "</s>"] for t in texts]
    base = 1 / (len({w for t in tokens for w in t}) + 1)
    seats = collections.defaultdict(lambda: collections.defaultdict(list))  # context -> dish -> sizes of its tables
    top: dict = {}

    def chance(context, word):
        def level(dishes, parent):
            own, n, t = dishes.get(word, []), sum(map(sum, dishes.values())), sum(map(len, dishes.values()))
            return (max(sum(own) - discount * len(own), 0) + (strength + discount * t) * parent) / (n + strength)

        uni = level(top, base)
        return level(seats[context], uni) if context in seats else uni

    def sit(dishes, word, parent):
        tables = dishes.setdefault(word, [])
        new = (strength + discount * sum(map(len, dishes.values()))) * parent
        pick = rng.random() * (new + sum(n - discount for n in tables))
        for i, n in enumerate(tables):
            pick -= n - discount
            if pick < 0:
                tables[i] += 1
                return False
        tables.append(1)
        return True

    def leave(dishes, word):
        tables = dishes[word]
        i = rng.choices(range(len(tables)), tables)[0]
        tables[i] -= 1
        if not tables[i]:
            del tables[i]
            if not tables:
                del dishes[word]
            return True
        return False

    moves = [(a, b) for t in tokens for a, b in zip(["<s>", *t], t)]
    uni = lambda w: chance(("none",), w)
    sums = [0.0] * len(held_out)
    for sweep in range(sweeps):
        for context, word in moves:
            if sweep and leave(seats[context], word):
                leave(top, word)
            if sit(seats[context], word, uni(word)):
                sit(top, word, base)
        if sweep >= burn_in:
            for i, t in enumerate(held_out):
                words = [*t.split(), "</s>"]
                sums[i] += sum(math.log10(chance(a, b)) for a, b in zip(["<s>", *words], words))
    return [s / (sweeps - burn_in) for s in sums]


def test_lm_against_a_plain_sampler(spark):
    rng = random.Random(2)
    text = lambda: " ".join(f"t{(a := (a * 3 + rng.randrange(3)) % 30 if j else rng.randrange(30))}" for j in range(20)) if (a := 0) is not None else ""
    learnt, held = [text() for _ in range(60)], [text() for _ in range(12)] + ["t1 new t2", ""]
    _, log = lm(spark, learnt)
    got = []
    for t in held:
        hashes = [int(h) for h in np.append(lm_score.word_hashes(t.encode()), lm_score.END)]
        got.append(sum(log(a, b) for a, b in zip([int(lm_score.BEGIN), *hashes], hashes)))
    ones = collections.Counter(p for t in learnt for p in zip(["<s>", *t.split()], [*t.split(), "</s>"]))
    n1, n2 = (sum(c == n for c in ones.values()) for n in (1, 2))
    want = plain_sampler(learnt, held, lm_score.STRENGTH, min(0.95, max(0.1, n1 / (n1 + 2 * n2))))
    assert sum(got) == pytest.approx(sum(want), rel=0.01)
    assert got == pytest.approx(want, rel=0.04)


PAGE = """<html><head><title>t</title><script>var x="</p>";</script></head><body><header class="site-header"><h1>Site</h1></header>
<div class="cookie-notice">We use cookies</div><nav><a href=/a>Menu</a></nav><div class="story-%d"><article><h1>Head %d</h1><p>One &amp; two<br>three %d
<p>Four %d</p><div class="ad-slot">Buy</div><form><p>Mail</p></form><section id="comments"><p>nice</p></section></article></div>
<aside>side</aside><footer>&copy; x</footer></body>"""


def test_html(spark):
    rows = [(i, f"https://h.example/{i}", PAGE % (i, i, i, i)) for i in range(12)] + [(50, None, None), (51, "x", ""), (52, "https://h.example/2", PAGE % (2, 2, 2, 2)), (2, "https://h.example/2", PAGE % (2, 2, 2, 2))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "row": F.lit(2), "slots": F.lit(3)})
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert all(got[i] == f"Head {i}\n\nOne & two three {i}\n\nFour {i}" for i in (0, 5, 11))
    assert got[3].startswith("Head 3\n\nOne & two three 3") and "Buy" not in got[3] and "nice" not in got[3] and "cookies" not in got[3]
    assert got[50] == "" and got[51] == "" and got[52] == got[2]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_without_article(spark):
    page = '<body><div id="wrap"><div class="top">t</div><div class="text"><p>Long text %d of this page, with more words.</p><p>Again %d</p></div><div class="links"><a href=/>all of the links of this site here</a></div></div></body>'
    rows = [(i, f"http://a/{i}", page % (i, i)) for i in range(4)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in got.collect()} == {i: f"Long text {i} of this page, with more words.\n\nAgain {i}" for i in range(4)}


@pytest.mark.parametrize("name", ["content", "wrap"])
def test_html_keeps_title_and_lead_beside_the_text(spark, name):
    page = '<body><div class="menu">m</div><div id="%s"><h1>Title %d</h1><div class="lead">Lead %d</div><div class="text"><p>The long text %d of this page.</p></div>%s<div class="more"><a href=/>links to all of the site</a></div></div></body>'
    rows = [(i, f"http://a/{i}", page % (name, i, i, i, f"<p>Tail {i}</p>" * (i % 3))) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(9):
        assert got[i].startswith("\n\n".join([f"Title {i}", f"Lead {i}", f"The long text {i} of this page.", *[f"Tail {i}"] * (i % 3)]))
    assert name == "content" or "links" not in got[0]


def by_host(sources):
    """The template of pages of one host, from occurrence vectors written out page by page."""
    pages = [html_extract.page_tokens(html_extract.Page(x)) for x in sources]
    tokens = {t for p in pages for t in p}
    vectors = {t: tuple(p.get(t, [0])[0] for p in pages) for t in tokens}
    number = {v: i for i, v in enumerate(sorted(set(vectors.values())))}
    rows = []
    for t in sorted(tokens):
        seen = [p[t] for p in pages if t in p]
        if len(seen) >= html_extract.FREQUENT * len(pages):
            rows.append((t, number[vectors[t]], len(seen), *[sum(x[i] for x in seen) for i in range(3)]))
    return html_extract.deduce(rows)


def test_template_decides():
    page = '<body><div class="a1"><div>Offer %d of the day, see <a href=/x>all our offers of the day and more</a></div></div><div class="b2"><p>Same on all pages.</p><p>Own text %d of the page, quite long.</p></div></body>'
    sources = [page % (i, i) for i in range(9)]
    template = by_host(sources)
    assert template.slots == ["/body/div.b0"] and len(template.texts) == 1
    assert html_extract.main_text(sources[3], template) == "Own text 3 of the page, quite long."
    none = html_extract.Template([], [], [])
    assert html_extract.main_text(sources[3], none) != html_extract.main_text(sources[3], template)
    assert html_extract.main_text('<body><div class="b2"><p>Same on all pages.</p></div></body>', template) == "Same on all pages."


def test_labels_are_of_repeated_elements():
    """A word in a class says nothing about an element of one page, but about one that the host's pages repeat."""
    page = '<body><nav>n</nav><article><h1>T %d</h1><p>Text %d</p>%s<div class="share-box">Share %d</div></article></body>'
    own = ['<div class="social"><p>Social history</p></div>', '<div class="related-work">Related work</div>', '<blockquote class="reply">A reply</blockquote>']
    sources = [page % (i, i, own[i] if i < 3 else "", i) for i in range(12)]
    template = by_host(sources)
    assert template.drops == ["/body/article/div.share-box"]
    assert [html_extract.main_text(s, template) for s in sources[:4]] == [
        f"T {i}\n\nText {i}" + x for i, x in enumerate(["\n\nSocial history", "\n\nRelated work", "\n\nA reply", ""])
    ]
    alone = html_extract.main_text(f"<article><p>a</p>{''.join(own)}</article>", html_extract.Template([], [], []))
    assert alone == "a\n\nSocial history\n\nRelated work\n\nA reply"


@pytest.mark.parametrize("pages", [3, 7, 8, 20])
def test_headings_that_repeat_stay(pages):
    """What all articles of a host say is part of each, however many pages there are."""
    sources = [f"<body><header>Site</header><article><h2>Abstract</h2><p>Own text {i}.</p></article><footer>end</footer></body>" for i in range(pages)]
    template = by_host(sources)
    assert {html_extract.main_text(s, template) for s in sources} == {f"Abstract\n\nOwn text {i}." for i in range(pages)}


def test_names_of_several_words():
    """A name is boilerplate if all its words may be."""
    none = html_extract.Template([], [], [])
    kept, gone = ["notice-of-motion", "ads-market", "menuOfTheDay", "history-of-advertising"], ["ad", "ad-slot", "cookie-banner", "site-footer", "commentlist", "sponsored post2"]
    for name in kept + gone:
        text = html_extract.main_text(f'<article><p>a</p><div class="{name}">b</div></article>', none)
        assert text == ("a\n\nb" if name in kept else "a"), name


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "deep", "<div>x" * 50_000, "<b>" * 100_000 + "<h2>a" * 1000 + "</i>" * 100_000, "<ul><li>" * 40_000 + "deep" + "</li></ul>" * 40_000])
def test_html_deep_nesting(page):
    """Time and memory are linear in the depth."""
    tracemalloc.start()
    began = time.process_time()
    tokens = html_extract.page_tokens(html_extract.Page(page))
    taken, peak = time.process_time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert taken < 30 and peak < 200 << 20 and len(tokens) < 1000
    assert html_extract.main_text(page, html_extract.Template([], [], []))


def test_html_equals_written_out_vectors(spark):
    """Hashed, summed vectors and the joins of the operator give what vectors written out page by page give."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    hosts = {}
    for r in rows.collect():
        hosts.setdefault((r["url"] or "").lower().split("/")[2], []).append(r)
    want = {}
    for pages in hosts.values():
        template = by_host([r["html"] for r in pages])
        want |= {r["page_id"]: html_extract.main_text(r["html"], template) for r in pages}
    assert {r["page_id"]: r["text"] for r in html_extract.extract(rows).collect()} == want
    html_extract.BROADCAST_BYTES, before = -1, html_extract.BROADCAST_BYTES
    try:
        assert {r["page_id"]: r["text"] for r in html_extract.extract(rows).collect()} == want
    finally:
        html_extract.BROADCAST_BYTES = before


def test_html_odd_pages(spark):
    long = "<p>" + "word " * 200_000
    rows = [(1, "http://a/1", f"<article>{long}"), (2, "http://b/2", "<b>x<i>y</b>z"), (3, None, "<p>a<p>b"), (3, None, "<p>a<p>b"), (4, "http://c/4", "<")]
    names = "page_id long, url string, html string, slots string, drops string, texts string, template string, row string, host string"
    df = spark.createDataFrame([(*r, *"abcdef") for r in rows], names)
    got = html_extract.extract(df).collect()
    assert len(got) == 5 and all([*r][3:9] == [*"abcdef"] for r in got)
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts == {1: ("word " * 200_000).strip(), 2: "xyz", 3: "a\n\nb", 4: "<"}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)]
    of = {n: n for p in pairs for n in p}
    for a, b in pairs:
        low, high = sorted((of[a], of[b]))
        of = {n: low if c == high else c for n, c in of.items()}
    got = components(spark.createDataFrame(pairs, "a long, b long"), Workspace(spark, "test"))
    alone = {n for n in of if all(n not in p or p[0] == p[1] for p in pairs)}
    assert {r["node"]: r["component"] for r in got.collect()} == {n: c for n, c in of.items() if n not in alone}
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "test")).count() == 0


def test_tokens_of_the_language_model(monkeypatch):
    texts = [" A b\x0bc  d\n", "", None, "\x1cx\x85y é É\xa0Z", "zz zz", "a " * 9, "\t\n"]
    plain = [np.append(lm_score.word_hashes((t or "").encode()), lm_score.END) for t in texts]
    found = lm_score.tokens_of(pa.array(texts, pa.string()))
    assert found.sizes.tolist() == [len(p) for p in plain] and found.flat.tolist() == np.concatenate(plain).tolist()
    before = [[lm_score.BEGIN, *p[:-1]] for p in plain]
    assert found.words[found.before()].tolist() == [w for p in before for w in p]
    # A word is hashed once, however often it is there.
    hashed = []
    monkeypatch.setattr(lm_score, "hashes_of", lambda words: hashed.extend(words) or np.zeros(len(words), np.uint64))
    lm_score.tokens_of(pa.array(["a b a"] * 100))
    assert sorted(hashed) == [b"a", b"b"]
    # Runs end by bytes and by tokens, and no row is lost.
    monkeypatch.undo()
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 8)
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 3)
    batch = pa.record_batch([pa.array(texts, pa.string())], ["text"])
    runs = list(lm_score._batches_of_tokens(iter([batch, batch.slice(0, 0)]), 0))
    assert [b for b, *_ in runs] == [0, *[e for _, e, *_ in runs][:-1]] and runs[-1][1] == len(texts) and len(runs) > 3
    assert [h for *_, t in runs for h in t.flat.tolist()] == found.flat.tolist()
    place = np.array([70000, 3, 70000, 1 << 31, 3, 0])
    assert lm_score._by_place(place).tolist() == np.argsort(place, kind="stable").tolist()
