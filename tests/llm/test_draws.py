"""Importance resampling, mixing and ranked search against plain versions, and their rows at the edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodeweave.llm import importance, mixing, ranked_search
from lodeweave.llm.words import Words, run_hashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["", None, "A", " a B ", "é-É x\u0085y", "z" * 5000 + " end", "one\ntwo_three", "İ K", "\x00", "日本 語A1", "tail"]
CLASHES = "_at _part _before k0 n_words weight score rank item doc size target place upto finish epoch".split()


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def some_text(rng, n, vocabulary=60):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


def table(spark, rows, more="source string"):
    names = [c for c in CLASHES if c not in more]
    return spark.createDataFrame([(*r, *names) for r in rows], f"doc_id long, text string, {more}, {', '.join(f'`{c}` string' for c in names)}")


@pytest.mark.parametrize("most", [1, 3])
def test_words_and_hashes(most):
    texts = pa.array([*ODD, *ODD])
    for column in (texts, texts.slice(3, 11), pa.array(ODD, pa.large_string()), pa.array([], pa.string())):
        plain = [words_of(t) for t in column.to_pylist()]
        found = Words(column)
        assert found.strings().to_pylist() == [w for row in plain for w in row]
        assert found.counts().tolist() == [len(row) for row in plain]
        for n, (rows, hashes) in enumerate(run_hashes(found, most), 1):
            want = [(i, zlib.crc32(" ".join(row[j : j + n]).encode())) for i, row in enumerate(plain) for j in range(len(row) - n + 1)]
            assert list(zip(rows.tolist(), hashes.tolist())) == want


def plain_resample(docs, target, percent=10, buckets=10_000, least=20, most=1):
    runs = lambda t: [" ".join(w[i : i + n]) for w in [words_of(t)] for n in range(1, most + 1) for i in range(len(w) - n + 1)]
    place = lambda r: zlib.crc32(r.encode()) % buckets
    s, t = (Counter(place(r) for x in texts for r in runs(x)) for texts in ([d[1] for d in docs], target))
    every = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * every[0] / ((s[b] + 1) * every[1])))
    out = []
    for id_, text in docs:
        got = [gain(place(r)) for r in runs(text)]
        weight = sum(got) // len(got) if got else 0
        h = int(hashlib.sha256(f"2024:{id_}".encode()).hexdigest()[:8], 16)
        out.append([id_, len(got), weight, None if id_ is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r, d in zip(out, docs) if r[0] is not None and len(words_of(d[1])) >= least), key=lambda r: (-r[3], r[0]))
    for n, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = n
    return [tuple(r) for r in out]


@pytest.mark.parametrize("most", [1, 2])
def test_resample(spark, most):
    rng = random.Random(5)
    docs = [(i, some_text(rng, rng.randrange(60))) for i in range(90)] + [(None, some_text(rng, 40)), (None, None), (7, some_text(rng, 30)), *[(500 + i, t) for i, t in enumerate(ODD)]]
    docs += docs[:3]
    target = [some_text(rng, 30, 9), None, "w1 W2", ""]
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(table(spark, [(*d, "s") for d in docs]), items, percent=30, most_words=most, keep=["source", "_at", "score"])
    assert got.columns == ["doc_id", "source", "_at", *importance.MADE]
    plain = plain_resample(docs, target, percent=30, most=most)
    rows = [(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(plain, key=repr)
    assert {(r["source"], r["_at"]) for r in got.collect()} == {("s", "_at")}
    assert importance.resample(table(spark, []), items).count() == 0
    assert {r["rank"] for r in importance.resample(table(spark, [(1, None, "s"), (2, "", "s")]), items.limit(0)).collect()} == {None}


def plain_targets(sizes, weights=(5, 2, 1), epochs=3):
    """By sharing what is over again and again, in small steps of sets."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        open_ = [s for s in names if s not in full]
        left = sum(sizes.values()) - sum(epochs * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > epochs * sizes[s]}
        if not over:
            return share | {s: float(epochs * sizes[s]) for s in full}
        full |= over


def test_mix(spark):
    rng = random.Random(8)
    docs = [(i, some_text(rng, rng.randrange(1, 40)), rng.choice(["big"] * 6 + ["a", "B", "é", "tiny", None])) for i in range(400)]
    docs += [(None, "x y z", "big"), (None, "x", "big"), (3, "again here", "a"), (3, "again here", "a"), (900, None, "nothing"), (901, " \n", "big"), (902, "one", "zz")]
    got = mixing.mix(table(spark, docs)).collect()
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len((text or "").split())
    targets = plain_targets(sizes)
    assert sorted(((r["id"], r["size"], r["source"], r["source_size"]) for r in got), key=repr) == sorted(((i, len((t or "").split()), s, sizes[s]) for i, t, s in docs), key=repr)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(targets[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s, n in taken.items():
        assert abs(n - targets[s]) <= longest[s] + 0.01 * targets[s]
    assert sum(taken.values()) <= sum(sizes.values()) < sum(taken.values()) + max(longest.values())
    again = mixing.mix(table(spark, docs[::-1]).repartition(7)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.mix(table(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(table(spark, [(1, None, "a"), (2, "", None)])).collect()] == [0, 0]
    assert [r["taken"] for r in mixing.mix(table(spark, [(1, "just one", "a")])).collect()] == [2]


def plain_search(docs, items, k=10):
    rows = [(i, Counter(words_of(t))) for i, t in docs]
    rows = [(i, c, c.total()) for i, c in rows if c]
    n_docs, n_terms = len(rows), sum(n for *_, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in rows:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words_of(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, place, i, -s) for place, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


@pytest.mark.parametrize("shard_bytes", [300, 1 << 20])
def test_search(spark, shard_bytes):
    rng = random.Random(3)
    docs = [(i, some_text(rng, rng.randrange(60))) for i in range(150)] + [(None, "w1 w2 rare"), (None, "w1 w2 rare"), (5, "w1 rare"), *[(700 + i, t) for i, t in enumerate(ODD)]]
    docs += [(800 + i, "tie tie w3") for i in range(15)] + [(2000, some_text(rng, 4000, 500))]
    items = [(i, some_text(rng, rng.randrange(12))) for i in range(20)] + [(50, "TIE w3"), (50, "unknown words"), (51, None), (None, "rare A1 日本"), (52, "w1 " * 50 + "rare")]
    asked = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc string")
    index = ranked_search.build_index(table(spark, [(*d, "s") for d in docs]).repartition(3), shard_bytes=shard_bytes)
    for block in (5, 10_000):
        got = [(r["item_id"], r["rank"], r["doc"], r["score"]) for r in ranked_search.search(index, asked, block_terms=block).collect()]
        assert sorted(got, key=repr) == sorted(plain_search(docs, items), key=repr)
    assert ranked_search.search(index, asked.limit(0)).count() == 0
    assert ranked_search.search(ranked_search.build_index(table(spark, [(1, None, "s")])), asked).count() == 0


def test_max_score_is_exact():
    """Whatever the bounds cut away, the best k and their scores are those of adding all up."""
    rng = np.random.default_rng(4)
    skipped = 0
    for _ in range(300):
        n, k = int(rng.integers(1, 400)), int(rng.integers(1, 12))
        lists = []
        for _ in range(int(rng.integers(1, 9))):
            docs = np.flatnonzero(rng.random(n) < rng.choice([0.02, 0.3, 0.9]))
            if len(docs):
                gained = rng.integers(1, int(rng.choice([3, 50, 5000])), len(docs))
                lists.append((int(gained.max()), docs, gained))
        whole = np.zeros(n, np.int64)
        for _, docs, gained in lists:
            whole[docs] += gained
        best = np.sort(whole[whole > 0])[::-1][:k]
        for floor in (0, int(best[-1]) if len(best) == k else 0):
            found, scores = ranked_search.max_score(lists, n, floor, k)
            assert (whole[found] == scores).all()
            want = set(np.flatnonzero((whole > 0) & (whole >= (best[-1] if len(best) == k else 1))).tolist())
            assert want <= set(found.tolist())
            skipped += n - len(found)
    assert skipped


def test_parities_bound_the_difference():
    """The bits in which two sets' parities differ are never more than the shingles they differ in."""
    from lodeweave.llm.substring_dedup import _parities

    rng = np.random.default_rng(1)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, int(rng.integers(0, 200)))) for _ in range(2))
        apart = sum(int(x).bit_count() for x in (_parities(a) ^ _parities(b)).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b)) and (apart == 0 if np.array_equal(a, b) else True)
