"""Toxicity by weak supervision.

Voters look at a document and vote or abstain: words of a fixed lexicon, and
words and word heads (patterns of 4 to 6 leading letters) mined from labelled
training rows. A head is kept when so many toxic and so few other documents with
it would not come about by chance among all the candidates tested.

A generative label model treats the true label as hidden: each voter has a rate
of voting under each class (its accuracy), the given label is one more voter with
an accuracy of its own, and voters that go together within a class (their
correlation) share their weight. Expectation maximisation gives each training
row a posterior label; a linear classifier (logistic regression over the votes)
is trained on the posteriors and scores all documents.

Only the fit uses a sample: SAMPLE_ROWS labelled rows at most, by a hash of the
id, and MOST_VOTERS voters. Scores read the whole text and nothing else.

Defined results: an empty table gives an empty table; repeated rows score alike;
other columns pass through whatever their names, but score_col is replaced; null and empty texts have no votes and the classifier's bias as
score; labels that are null don't count; of several labels of an id the highest
counts; without any usable label the fixed lexicon alone decides.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, map_arrow

#: The bound of the labelled sample.
SAMPLE_ROWS = 40_000
#: The bound of mined voters, the most telling first; it bounds the fit on the driver and what is broadcast.
MOST_VOTERS = 512
HEADS = (4, 5, 6)
#: Of the mined voters, so many may be there by accident (false discovery rate over all candidates tested).
FALSE_SHARE = 0.05
EM_TURNS = 30

# A small lexicon of English insults.
LEXICON = """
    idiot idiots idiotic moron morons moronic stupid loser losers scum scumbag trash worthless pathetic disgusting
    clown clowns dumb dumbass imbecile cretin jerk bastard bitch asshole fool filth vermin retard pig whore slut
    creep freak lowlife degenerate garbage crap shit fuck fucking damn bullshit
""".split()

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def word_set(text: bytes | None) -> set[bytes]:
    return set((text or b"").translate(_WORDS).split())


def _head(word: bytes, letters: int) -> bytes | None:
    """The first letters of a word that is longer than that; code points, not bytes."""
    if len(word) <= letters:
        return None
    if word.isascii():
        return word[:letters]
    text = word.decode("utf-8", "ignore")
    return text[:letters].encode() if len(text) > letters else None


def candidates(text: bytes | None) -> set[bytes]:
    """Words as they are, heads with a star behind them."""
    words = word_set(text)
    found = set(words)
    for word in words:
        for letters in HEADS:
            head = _head(word, letters)
            if head:
                found.add(head + b"*")
    return found


@dataclass
class Voters:
    names: list[bytes]

    def __post_init__(self) -> None:
        self.number = {name: i for i, name in enumerate(self.names)}
        # Every voter begins with one of these; most words are told apart by that alone.
        self.begins = {name.rstrip(b"*")[:3] for name in self.names}

    def votes(self, text: bytes | None) -> list[int]:
        found = set()
        begins, number = self.begins, self.number
        for word in {w for w in (text or b"").translate(_WORDS).split() if w[:3] in begins}:
            if word in number:
                found.add(number[word])
            for letters in HEADS:
                head = _head(word, letters)
                if head and head + b"*" in number:
                    found.add(number[head + b"*"])
        return sorted(found)


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray
    bias: float
    accuracies: np.ndarray
    correlations: np.ndarray

    def score(self, text: bytes | None) -> float:
        value = self.bias + sum(self.weights[v] for v in self.voters.votes(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, value))))


def label_model(votes: np.ndarray, gold: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for each vote pattern; each voter's rates by class; within-class correlations."""
    n, k = votes.shape
    total = counts.sum()
    posterior = np.where(gold == 1, 0.9, np.where(gold == 0, 0.1, 0.5))
    share = np.ones(k)
    rates, correlation = np.zeros((2, k)), np.zeros((k, k))
    for turn in range(EM_TURNS):
        ones, zeros = posterior * counts, (1 - posterior) * counts
        prior = (ones.sum() + 1) / (total + 2)
        rates = np.stack([(zeros @ votes + 0.05) / (zeros.sum() + 1), (ones @ votes + 0.5) / (ones.sum() + 1)])
        right1 = (ones[gold == 1].sum() + 9) / (ones[gold >= 0].sum() + 10)
        right0 = (zeros[gold == 0].sum() + 9) / (zeros[gold >= 0].sum() + 10)
        if turn % 5 == 0 and k:
            rest = (votes - (posterior[:, None] * rates[1] + (1 - posterior)[:, None] * rates[0])) * np.sqrt(counts)[:, None]
            spread = rest.T @ rest
            scale = np.sqrt(np.maximum(np.diag(spread), 1e-9))
            correlation = spread / scale[:, None] / scale
            np.fill_diagonal(correlation, 0)
            share = 1 / (1 + np.where(correlation > 0.1, correlation, 0).sum(1))
        yes = (np.log(rates[1]) - np.log(rates[0])) * share
        no = (np.log1p(-rates[1]) - np.log1p(-rates[0])) * share
        logit = math.log(prior / (1 - prior)) + votes @ (yes - no) + no.sum()
        logit += np.where(gold == 1, math.log(right1 / (1 - right0)), np.where(gold == 0, math.log((1 - right1) / right0), 0))
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return posterior, rates, correlation


def linear_fit(votes: np.ndarray, target: np.ndarray, counts: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method."""
    n, k = votes.shape
    x = np.concatenate([votes, np.ones((n, 1))], axis=1)
    w = np.zeros(k + 1)
    ridge = np.diag([penalty] * k + [1e-3])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (p - target)) + ridge @ w
        hessian = (x * (counts * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 8 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return w[:k], float(w[k])


def _mine(sample: DataFrame, most: int) -> list[bytes]:
    """Candidates that toxic rows have more often than chance allows, the most telling ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, other = Counter(), Counter()
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for text, label in zip(batch.column(0).cast(pa.binary()).to_pylist(), labels):
                (toxic if label else other).update(candidates(text))
        names = list(toxic)  # what no toxic row of this task has can only count against candidates of other tasks
        names += [name for name in other if name not in toxic]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([other[x] for x in names], pa.int64())],
            names=["name", "toxic", "other"],
        )

    counted = map_arrow(sample.select("text", "toxic"), run, "name binary, toxic long, other long")
    counted = counted.groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    rows = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n, positive = rows[0], rows[1] or 0
    if not positive or positive == n:
        return []
    share = positive / n
    seen = F.col("toxic") + F.col("other")
    rate = F.col("toxic") / seen
    # Chernoff's bound on drawing so many toxic rows among those that have the candidate.
    log_chance = -seen * (
        rate * F.log(rate / share)
        + F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    )
    tested = max(1, counted.filter("toxic > 1").count())
    best = (
        counted.filter((F.col("toxic") > 1) & (rate > max(0.5, 2 * share if share < 0.25 else 0.5)))
        .withColumn("chance", log_chance)
        .orderBy("chance", "name")
        .limit(most)
        .collect()
    )
    passed = [i for i, row in enumerate(best, 1) if row["chance"] <= math.log(FALSE_SHARE * i / tested)]
    return [bytes(row["name"]) for row in best[: max(passed, default=0)]]


def _votes(sample: DataFrame, voters: Voters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct vote patterns with their labels and numbers; rows with equal votes count as one pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [voters.votes(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.list_(pa.int32())), batch.column(1)], names=["votes", "toxic"])

    found = map_arrow(sample.select("text", "toxic"), run, "votes array<int>, toxic int")
    rows = found.groupBy("votes", "toxic").count().orderBy("votes", "toxic").collect()
    matrix = np.zeros((len(rows), len(voters.names)))
    for i, row in enumerate(rows):
        matrix[i, row[0]] = 1
    return matrix, np.array([r[1] for r in rows]), np.array([float(r[2]) for r in rows])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, most_voters: int = MOST_VOTERS
) -> Model:
    """labels: (id_col, toxic); only these rows' labels are learnt from, so leave held-out ones out.

    sample_rows, most_voters: bounds of the fit; scores cover all rows whatever these are.
    """
    space = Workspace(docs.sparkSession, "toxicity")
    known = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("doc")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    if n > sample_rows:
        known = known.filter(F.pmod(F.xxhash64("doc"), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    # At most about sample_rows (id, label) pairs: a bound that is a parameter, so the documents aren't shuffled.
    texts = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = space.stage(texts.join(F.broadcast(known), "doc").select("text", "toxic"), "sample")
    fixed = [word.encode() for word in LEXICON]
    voters = Voters(list(dict.fromkeys([*_mine(sample, most_voters), *fixed])))
    votes, gold, counts = _votes(sample, voters)
    space.drop("sample")
    if not len(counts) or not gold.any():
        is_fixed = np.array([name in set(fixed) for name in voters.names], dtype=float)
        return Model(voters, 4 * is_fixed, -2.0, np.zeros((2, len(is_fixed))), np.zeros((len(is_fixed),) * 2))
    posterior, rates, correlation = label_model(votes, gold, counts)
    weights, bias = linear_fit(votes, posterior, counts)
    return Model(voters, weights, bias, rates, correlation)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col, a double from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_VOTERS and the lexicon at most
    kept = [c for c in docs.columns if c != score_col]
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = shared.value.score
        for batch in batches:
            scores = [rate(t) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*kept, score_col])

    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(score_col, T.DoubleType())])
    return map_arrow(docs.select(*[f"`{c}`" for c in kept]), run, schema)


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0
