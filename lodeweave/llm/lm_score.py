"""Language-model scores from a hierarchical Pitman-Yor bigram model.

Every word of the training tokens is a symbol of its own, at every size. Each
word (and the beginning of a document) is a context with a restaurant; all share
the unigram restaurant as parent, whose base is uniform over the known words and
one unknown.

A Gibbs sweep takes the customers of a dish in a restaurant out and seats them
anew one after another, given everyone else: at a new table in proportion to
(strength + discount * tables) * parent's probability, else at an old one. Dishes
of one customer have one table. New tables are the parent's customers; its own
seating is sampled after each sweep. Sweeps run over all restaurants at once on
the totals of the sweep before. After BURN_IN sweeps, SAMPLES of them are
averaged. From RUN customers on, those of a dish are seated in runs of about
1/32 of its number so far, with one chance for the run.

No table of words is ever on the driver or in every task. Bigrams lie in pair
parts by a hash of the pair, words in word parts by a hash of the word, as sorted
compressed arrays; parts grow in number with the corpus, not in size. In a sweep
each pair part sends the word parts its sums by word (customers for the parent,
tables of the context) and gets back the totals and probabilities of its own
words. The driver has a few sums, and the hot words and bigrams, at most
1 / HOT_WORD and 1 / HOT_PAIR, which are broadcast so that no key makes a part large.

To score, a token's backed-off log probability is one term of the word and one of
the word before: word parts give a block of documents one sum a document, and
what bigrams that were seen add is looked up in the pair parts in the same way.

Defined results: null and empty texts are one end token; a null id is a held-in
row and comes back as null; repeated rows are learnt from and scored like any
others; without training rows every token has probability one; columns of other
names are not looked at. Of very long texts a task holds the tokens once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, map_arrow, pack, unpack
from .shingles import hashes_of, mix, word_hashes  # noqa: F401 (word_hashes: one text, for tests)

HOT_WORD, HOT_PAIR = 1e-6, 1e-6
STRENGTH = 1.0
BURN_IN = 2
SAMPLES = 2
RUN = 64
BLOCK_BYTES, BLOCK_TOKENS = 13 << 20, 1 << 22
LEAST_PARTS, MOST_PARTS = 64, 1 << 15
#: Pair parts to a word part: there are far fewer words than bigrams.
PAIRS_TO_WORDS = 4
END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))
BEGIN = np.uint64(xxhash.xxh3_64_intdigest(b" begin"))
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# --- arrays as bytes ---------------------------------------------------------


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * _FIRST + mix(words * _SECOND + np.uint64(1)))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys) % np.uint64(parts)).astype(np.int64)


def by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of the keys of each part, in the order of the keys."""
    part = part_of(keys, parts)
    order = np.argsort(part.astype(np.uint16), kind="stable")  # 16 bits are sorted by counting; MOST_PARTS fit
    ends = np.cumsum(np.bincount(part, minlength=parts))
    start = 0
    for p, end in enumerate(ends.tolist()):
        if end > start:
            yield p, order[start:end]
        start = end


def _firsts(sorted_keys: np.ndarray) -> np.ndarray:
    """Positions at which a new key begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = _firsts(keys)
    return keys[first], *[np.add.reduceat(v[order], first) if len(first) else v for v in values]


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in the sorted ones, and whether they are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*[part.split() for part in schema.split(", ")])
    arrow = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(columns, kinds)], names=list(names))


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_rows(schema, rows)])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Rows of batches, one after another."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield [column[i].as_py() for column in batch.columns]


# --- counting ----------------------------------------------------------------


@dataclass
class Tokens:
    """The tokens of documents, one after another, as places in `words`, which are sorted and have both ends of documents in them."""

    words: np.ndarray
    place: np.ndarray
    sizes: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    @property
    def flat(self) -> np.ndarray:
        return self.words[self.place]

    def before(self) -> np.ndarray:
        """The place of the word before each token; a document starts after the beginning."""
        before = np.empty_like(self.place)
        before[1:] = self.place[:-1]
        before[self.starts] = np.searchsorted(self.words, BEGIN)
        return before


def tokens_of(texts: pa.Array) -> Tokens:
    """Words as words_of() has them; each distinct one is hashed once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    told = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.append(hashes_of(told), END)
    # White space at an end of a text leaves an empty word there.
    real = (pc.binary_length(coded.dictionary).to_numpy() > 0)[codes]
    ends = np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])]
    sizes = np.diff(ends) + 1
    words = np.unique(np.append(hashes, BEGIN))
    at = np.searchsorted(words, hashes)
    last = np.cumsum(sizes) - 1
    inner = np.ones(int(sizes.sum()), dtype=bool)
    inner[last] = False
    place = np.empty(len(inner), dtype=np.int64)
    place[inner], place[last] = at[codes[real]], at[-1]
    return Tokens(words, place, sizes)


def _cuts(amounts: np.ndarray, most: int) -> list[int]:
    """Ends of runs of about `most`: a run ends with the row that reaches it."""
    ends, held = [], 0
    for i, amount in enumerate(amounts.tolist()):
        held += amount
        if held >= most:
            ends.append(i + 1)
            held = 0
    return ends if ends and ends[-1] == len(amounts) else [*ends, len(amounts)]


def _batches_of_tokens(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, int, pa.RecordBatch, Tokens]]:
    """Runs of rows of about BLOCK_BYTES, at most about BLOCK_TOKENS: first row, end row, batch, their tokens."""
    for batch in batches:
        begin = 0
        for end in _cuts(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), BLOCK_BYTES) if batch.num_rows else []:
            found = tokens_of(batch.column(column).slice(begin, end - begin))
            first = at = 0
            for last in _cuts(found.sizes, BLOCK_TOKENS):
                sizes = found.sizes[first:last]
                upto = at + int(sizes.sum())
                yield begin + first, begin + last, batch, Tokens(found.words, found.place[at:upto], sizes)
                first, at = last, upto
            begin = end


@dataclass
class Pairs:
    """Distinct bigrams with their counts; both words as places in `words`, by which they are sorted."""

    words: np.ndarray
    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, tokens: Tokens) -> Pairs:
        """The bigrams of documents; `words` may have others too."""
        size = len(tokens.words)
        codes, counts = np.unique(tokens.before() * size + tokens.place, return_counts=True)
        return cls(tokens.words, codes // size, codes % size, counts)

    @classmethod
    def sum(cls, parts: list[Pairs]) -> Pairs:
        words = np.unique(np.concatenate([p.words for p in parts]))
        places = [np.searchsorted(words, p.words) for p in parts]
        codes = np.concatenate([at[p.first] * len(words) + at[p.second] for at, p in zip(places, parts)])
        codes, counts = sum_by(codes, np.concatenate([p.counts for p in parts]))
        return cls(words, codes // len(words), codes % len(words), counts)

    @property
    def keys(self) -> np.ndarray:
        return pair_keys(self.words[self.first], self.words[self.second])

    def only(self, at: np.ndarray) -> Pairs:
        """Those at some places, which come in order."""
        used = np.zeros(len(self.words), dtype=bool)
        used[self.first[at]] = used[self.second[at]] = True
        place = np.cumsum(used) - 1
        return Pairs(self.words[used], place[self.first[at]], place[self.second[at]], self.counts[at])

    def blobs(self) -> tuple[bytes, ...]:
        return (
            pack_sorted(self.words), pack(np.diff(self.first, prepend=0).astype(np.uint32)), pack(self.second.astype(np.uint32)), pack(self.counts.astype(np.uint64))
        )

    @classmethod
    def read(cls, words: bytes, first: bytes, second: bytes, counts: bytes) -> Pairs:
        return cls(unpack_sorted(words), np.cumsum(unpack(first, np.uint32), dtype=np.int64), unpack(second, np.uint32).astype(np.int64), unpack(counts, np.uint64).astype(np.int64))


_PAIRS = "part int, words binary, first binary, second binary, counts binary"


def count_pairs(texts: DataFrame, parts: int) -> DataFrame:
    """The distinct bigrams of all texts with their counts, one row a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for _, _, _, tokens in _batches_of_tokens(batches, 0):
            new = Pairs.of(tokens)
            held = Pairs.sum([held, new]) if held else new
        if held:
            for p, at in by_part(held.keys, parts):
                yield _rows(_PAIRS, [(p, *held.only(at).blobs())])

    def add(group: pa.Table) -> pa.Table:
        found = Pairs.sum([Pairs.read(*row[1:]) for row in _each(group.to_batches())])
        return _table(_PAIRS, [(group["part"][0].as_py(), *found.blobs())])

    return map_arrow(texts, run, _PAIRS).groupBy("part").applyInArrow(add, _PAIRS)


# --- seating -----------------------------------------------------------------


def seat(counts: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, strength: float, rng) -> np.ndarray:
    """Tables of each dish after its customers have sat down one after another.

    others: tables of the restaurant's other dishes; parent: the dish's probability there.
    """
    order = np.argsort(-counts, kind="stable")
    c, p = counts[order], parent[order]
    room = strength + discount * others[order]
    tables = np.ones(len(c))
    seated = 1
    active = int(np.searchsorted(-c, -1, side="left"))  # dishes with more than one customer
    while active:
        t = tables[:active]
        fresh = (room[:active] + discount * t) * p[:active]
        chance = fresh / (fresh + np.maximum(seated - discount * t, 1e-12))
        if seated < RUN:
            t += rng.random(active) < chance
            seated += 1
        else:
            run = max(1, seated // 32)
            t += rng.binomial(np.minimum(run, c[:active] - seated).astype(np.int64), chance)
            seated += run
        active = int(np.searchsorted(-c[:active], -seated, side="left"))
    out = np.empty(len(c))
    out[order] = tables
    return out


@dataclass
class Totals:
    """Sums over all words: tokens, distinct words, bigram tables (the unigram restaurant's customers) and its tables."""

    tokens: int
    distinct: int
    customers: float
    tables: float
    discount: float

    @property
    def uniform(self) -> float:
        return 1 / (self.distinct + 1)

    def unigram(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        own = np.maximum(customers - self.discount * tables, 0)
        return (own + (STRENGTH + self.discount * self.tables) * self.uniform) / (self.customers + STRENGTH)

    @property
    def unknown(self) -> float:
        return float(self.unigram(np.zeros(1), np.zeros(1))[0])


# A pair part's sums by word, to a word part: customers of the word's restaurant, its tokens, its tables, new tables for it.
_SUMS = "part int, sender int, words binary, customers binary, tokens binary, tables binary, brought binary"
# A word part's words with their sums; `seated` are the tables of the unigram restaurant.
_WORDS = "part int, words binary, customers binary, tokens binary, tables binary, brought binary, seated binary"
_ANSWERS = "part int, sender int, rooms binary, chances binary, customers binary"
_ROUND = "kind int, part int, sender int, words binary, customers binary, tokens binary, tables binary, brought binary, seated binary, chances binary"
_STATE = f"{_PAIRS}, seated binary, total binary"
_WORD, _ANSWER = 0, 1


def _send_sums(state: DataFrame, word_parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            pairs, tables = Pairs.read(*row[1:5]), unpack(row[5], np.uint32)
            size = len(pairs.words)
            sums = [
                np.bincount(pairs.first, pairs.counts, size), np.bincount(pairs.second, pairs.counts, size),
                np.bincount(pairs.first, tables, size), np.bincount(pairs.second, tables, size),
            ]
            rows = [(r, row[0], pack_sorted(pairs.words[at]), *[pack(s[at].astype(np.uint64)) for s in sums]) for r, at in by_part(pairs.words, word_parts)]
            yield _rows(_SUMS, rows)

    return map_arrow(state, run, _SUMS)


def _round(sums: DataFrame, before: Totals, sweep: int) -> DataFrame:
    """Adds the sums up by word, seats the unigram restaurant, and answers each sender for its own words."""

    def add(group: pa.Table) -> pa.Table:
        rows = list(_each(group.to_batches()))
        lists = [unpack_sorted(r[2]) for r in rows]
        values = [np.concatenate([unpack(r[i], np.uint64) for r in rows]).astype(np.float64) for i in range(3, 7)]
        words, customers, tokens, tables, brought = sum_by(np.concatenate(lists), *values)
        seated = np.zeros(len(words))
        served = brought > 0
        rng = np.random.default_rng([17, sweep, rows[0][0]])
        seated[served] = seat(brought[served].astype(np.int64), np.full(int(served.sum()), before.tables), np.full(int(served.sum()), before.uniform), before.discount, STRENGTH, rng)
        chances = before.unigram(brought, seated)
        none = b""
        out = [(_WORD, rows[0][0], -1, pack_sorted(words), *[pack(x.astype(np.float64)) for x in (customers, tokens, tables, brought, seated)], none)]
        for r, asked in zip(rows, lists):
            at = np.searchsorted(words, asked)
            out.append((_ANSWER, r[0], r[1], none, none, none, pack(tables[at].astype(np.uint32)), none, none, pack(chances[at].astype(np.float32))))
        return _table(_ROUND, out)

    return sums.groupBy("part").applyInArrow(add, _ROUND)


def _spread(words: np.ndarray, word_parts: int, answers: list[list], column: int, dtype) -> np.ndarray:
    """Answers of the word parts, put back in the order of a pair part's words."""
    out = np.zeros(len(words))
    told = {row[0]: row[column] for row in answers}
    for r, at in by_part(words, word_parts):
        out[at] = unpack(told[r], dtype)
    return out


class _Model:
    """The restaurants, in parts: state (pair parts) and one round of word parts a sweep."""

    def __init__(self, space: Workspace, pairs: DataFrame, word_parts: int):
        self.space, self.word_parts = space, word_parts

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _each(batches):
                counts = unpack(row[4], np.uint64)
                yield _rows(_STATE, [(*row, pack(np.ones(len(counts), np.uint32)), pack(np.zeros(len(counts))))])

        def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _each(batches):
                counts = unpack(row[4], np.uint64)
                yield _rows("pairs long, tokens long, ones long, twos long", [(len(counts), int(counts.sum()), int((counts == 1).sum()), int((counts == 2).sum()))])

        self.state = space.stage(map_arrow(pairs, start, _STATE), "state-0")
        found = map_arrow(pairs, facts, "pairs long, tokens long, ones long, twos long").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("pairs", "tokens", "ones", "twos")]).first()
        n_pairs, tokens, ones, twos = found
        discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        # Until the words have been counted, the number of bigrams stands for theirs: no restaurant has more tables.
        self.totals = Totals(tokens, n_pairs, float(n_pairs), float(n_pairs), discount)
        self.sampled: list[tuple[str, Totals]] = []

    def sample(self) -> None:
        self._words(0)
        for sweep in range(1, BURN_IN + SAMPLES + 1):
            self._sweep(sweep)
            self._words(sweep)

    def _words(self, sweep: int) -> None:
        """Word totals of a sweep; those of a sampled one are kept."""
        name = f"words-{sweep}"
        self.round = self.space.stage(_round(_send_sums(self.state, self.word_parts), self.totals, sweep), name)
        schema = "distinct long, customers double, tables double"

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _each(batches):
                yield _rows(schema, [(int((unpack(row[5], np.float64) > 0).sum()), float(unpack(row[7], np.float64).sum()), float(unpack(row[8], np.float64).sum()))])

        sums = map_arrow(self.round.filter(F.col("kind") == _WORD), add, schema).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("distinct", "customers", "tables")]).first()
        self.totals = Totals(self.totals.tokens, int(sums[0]), float(sums[1]), float(sums[2]), self.totals.discount)
        if sweep > BURN_IN:
            self.sampled.append((name, self.totals))
        if sweep and sweep - 1 <= BURN_IN:
            self.space.drop(f"words-{sweep - 1}")

    def _sweep(self, sweep: int) -> None:
        discount, word_parts = self.totals.discount, self.word_parts
        keep = sweep > BURN_IN

        def run(state: pa.Table, told: pa.Table) -> pa.Table:
            answers = list(_each(told.to_batches()))
            out = []
            for row in _each(state.to_batches()):
                pairs, seated, total = Pairs.read(*row[1:5]), unpack(row[5], np.uint32).astype(np.float64), unpack(row[6], np.float64)
                tables = _spread(pairs.words, word_parts, answers, 1, np.uint32)
                chances = _spread(pairs.words, word_parts, answers, 2, np.float32)
                more = pairs.counts > 1
                first, second = pairs.first[more], pairs.second[more]
                rng = np.random.default_rng([sweep, row[0]])
                seated[more] = seat(pairs.counts[more], np.maximum(tables[first] - seated[more], 0), chances[second], discount, STRENGTH, rng)
                out.append((*row[:5], pack(seated.astype(np.uint32)), pack(total + seated if keep else total)))
            return _table(_STATE, out)

        answers = self.round.filter(F.col("kind") == _ANSWER).select("part", "tables", "chances", "sender")
        joined = self.state.groupBy("part").cogroup(answers.groupBy("sender")).applyInArrow(run, _STATE)
        self.state = self.space.stage(joined, f"state-{sweep}")
        self.space.drop(f"state-{sweep - 1}")

    def words(self) -> DataFrame:
        """(part, words, tokens, chances, rooms): of each word its tokens, its averaged unigram probability, and the log10
        of what its restaurant leaves to the parent."""
        sampled = self.sampled
        rounds = None
        for i, (name, _) in enumerate(sampled):
            rows = self.space.spark.read.schema(_ROUND).parquet(self.space.path(name)).filter(F.col("kind") == _WORD)
            rows = rows.select(F.lit(i).alias("sample"), "part", "words", "customers", "tokens", "tables", "brought", "seated")
            rounds = rows if rounds is None else rounds.unionByName(rows)

        def mean(group: pa.Table) -> pa.Table:
            # The words of a part are the same in every round.
            rows = list(_each(group.to_batches()))
            arrays = [[unpack(x, np.float64) for x in r[3:8]] for r in rows]
            chances = sum(sampled[r[0]][1].unigram(a[3], a[4]) for r, a in zip(rows, arrays)) / len(rows)
            tables = sum(a[2] for a in arrays) / len(rows)
            customers, tokens = arrays[0][:2]
            rooms = np.log10((STRENGTH + sampled[0][1].discount * tables) / (STRENGTH + customers))
            return _table(_FACTS, [(rows[0][1], rows[0][2], pack(tokens), pack(chances), pack(rooms), pack(customers))])

        return self.space.stage(rounds.groupBy("part").applyInArrow(mean, _FACTS), "facts")

    @property
    def unknown(self) -> float:
        """The averaged unigram probability of a word that was not learnt from."""
        return sum(t.unknown for _, t in self.sampled) / len(self.sampled)

    def gains(self, words: DataFrame) -> DataFrame:
        """(part, keys, gains, counts): log10 of what bigrams that were seen are likelier than backed off."""
        word_parts, discount = self.word_parts, self.totals.discount

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _each(batches):
                held = unpack_sorted(row[1])
                yield _rows("part int, sender int, words binary", [(r, row[0], pack_sorted(held[at])) for r, at in by_part(held, word_parts)])

        def answer(asked: pa.Table, facts: pa.Table) -> pa.Table:
            known = list(_each(facts.to_batches()))[0]
            held = unpack_sorted(known[1])
            chances, rooms, customers = (unpack(x, np.float64) for x in known[3:6])
            out = []
            for r, sender, wanted in _each(asked.to_batches()):
                at = np.searchsorted(held, unpack_sorted(wanted))
                out.append((r, sender, pack(rooms[at]), pack(chances[at]), pack(customers[at])))
            return _table(_ANSWERS, out)

        def gain(state: pa.Table, told: pa.Table) -> pa.Table:
            answers = [[r[0], *r[2:]] for r in _each(told.to_batches())]
            out = []
            for row in _each(state.to_batches()):
                pairs, tables = Pairs.read(*row[1:5]), unpack(row[6], np.float64) / SAMPLES
                rooms, chances, customers = (_spread(pairs.words, word_parts, answers, i, np.float64) for i in (1, 2, 3))
                own = np.maximum(pairs.counts - discount * tables, 0) / (STRENGTH + customers[pairs.first])
                gains = np.log10(1 + own / (10 ** rooms[pairs.first] * chances[pairs.second]))
                keys = pairs.keys
                order = np.argsort(keys)
                out.append((row[0], pack_sorted(keys[order]), pack(gains[order].astype(np.float32)), pack(pairs.counts[order].astype(np.uint64))))
            return _table(_GAINS, out)

        asked = map_arrow(self.state.select("part", "words"), ask, "part int, sender int, words binary")
        answers = asked.groupBy("part").cogroup(words.groupBy("part")).applyInArrow(answer, _ANSWERS)
        joined = self.state.groupBy("part").cogroup(answers.groupBy("sender")).applyInArrow(gain, _GAINS)
        return self.space.stage(joined, "gains")


_FACTS = "part int, words binary, tokens binary, chances binary, rooms binary, customers binary"
_GAINS = "part int, keys binary, gains binary, counts binary"


# --- scoring -----------------------------------------------------------------

_SENT = "part int, block long, kind int, keys binary, rows binary"
_STORED = "part int, kind int, keys binary, values binary, tokens binary"
_SUMMED = "block long, kind int, ids binary, sums binary"
#: Per document: tokens, known tokens, base score, score.
_WIDTH = 4
_DOCS, _OF_WORD, _OF_PAIR = 0, 1, 2


@dataclass
class Hot:
    """Words and bigrams that a large share of all tokens are, with what they add to a score."""

    words: np.ndarray
    tokens: np.ndarray
    logs: np.ndarray
    pairs: np.ndarray
    gains: np.ndarray
    begin: float
    unknown: float
    totals: Totals

    def base(self, tokens: np.ndarray) -> np.ndarray:
        return np.log10((tokens + 1) / (self.totals.tokens + self.totals.distinct + 1))


def _hot(words: DataFrame, gains: DataFrame, unknown: float, totals: Totals) -> Hot:
    """At most 1 / HOT_WORD words and 1 / HOT_PAIR bigrams, whatever the corpus."""
    word_floor, pair_floor = max(2, math.ceil(HOT_WORD * totals.tokens)), max(2, math.ceil(HOT_PAIR * totals.tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            held, tokens, chances, rooms = unpack_sorted(row[1]), *(unpack(x, np.float64) for x in row[2:5])
            keep = (tokens >= word_floor) | (held == BEGIN)
            logs = np.where(held[keep] == BEGIN, rooms[keep], np.log10(chances[keep]) + rooms[keep])
            yield _rows("keys binary, tokens binary, logs binary", [(held[keep].tobytes(), tokens[keep].tobytes(), logs.tobytes())])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            keep = unpack(row[3], np.uint64) >= pair_floor
            yield _rows("keys binary, gains binary", [(unpack_sorted(row[1])[keep].tobytes(), unpack(row[2], np.float32).astype(np.float64)[keep].tobytes())])

    found = map_arrow(words, run, "keys binary, tokens binary, logs binary").collect()
    keys, tokens, logs = (np.concatenate([np.zeros(0, t), *[np.frombuffer(bytes(r[i]), t) for r in found]]) for i, t in enumerate((np.uint64, np.float64, np.float64)))
    order = np.argsort(keys)
    keys, tokens, logs = keys[order], tokens[order], logs[order]
    begin = float(logs[keys == BEGIN].sum())
    plain = keys != BEGIN
    rows = map_arrow(gains, pairs, "keys binary, gains binary").collect()
    pair, gain = (np.concatenate([np.zeros(0, t), *[np.frombuffer(bytes(r[i]), t) for r in rows]]) for i, t in enumerate((np.uint64, np.float64)))
    order = np.argsort(pair)
    return Hot(keys[plain], tokens[plain], logs[plain], pair[order], gain[order], begin, unknown, totals)


def _stored(words: DataFrame, gains: DataFrame, word_parts: int) -> DataFrame:
    """What is looked up, by part: words first, bigrams behind them."""

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            tokens, chances, rooms = (unpack(x, np.float64) for x in row[2:5])
            yield _rows(_STORED, [(row[0], _OF_WORD, row[1], pack((np.log10(chances) + rooms).astype(np.float32)), pack(tokens.astype(np.uint64)))])

    def of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            yield _rows(_STORED, [(word_parts + row[0], _OF_PAIR, row[1], row[2], b"")])

    return map_arrow(words, of_words, _STORED).unionByName(map_arrow(gains, of_pairs, _STORED))


def _by_place(place: np.ndarray) -> np.ndarray:
    """The stable order of numbers below 2**32, by their halves."""
    order = np.argsort((place & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((place >> 16).astype(np.uint16)[order], kind="stable")]


def _send(docs: DataFrame, hot, word_parts: int, parts: int) -> DataFrame:
    """Of each block of documents: its own sums, and for each part the keys whose values it lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Hot = hot.value
        likely = np.zeros(1 << 22, dtype=bool)  # most bigrams are told from hot ones by their first bits
        likely[known.pairs >> np.uint64(42)] = True
        for begin, end, batch, tokens in _batches_of_tokens(batches, 1):
            ids = batch.column(0).slice(begin, end - begin)
            sizes, flat, number_of = tokens.sizes, tokens.flat, len(tokens.sizes)
            owner = np.repeat(np.arange(number_of, dtype=np.uint32), sizes)
            pairs = pair_keys(tokens.words[tokens.before()], flat)
            # Words are looked up once each, what they add is spread over the tokens.
            at, hot_word = find(known.words, tokens.words)
            base, logs = np.zeros(len(hot_word)), np.zeros(len(hot_word))
            base[hot_word], logs[hot_word] = known.base(known.tokens[at[hot_word]]), known.logs[at[hot_word]]
            common = hot_word[tokens.place]
            seen = likely[pairs >> np.uint64(42)]
            place, hit = find(known.pairs, pairs[seen])
            seen[seen] = hit
            sums = np.zeros((number_of, _WIDTH))
            sums[:, 0] = sizes
            sums[:, 1] = np.bincount(owner[common], minlength=number_of)
            sums[:, 2] = np.bincount(owner, base[tokens.place], number_of)
            sums[:, 3] = known.begin + np.bincount(owner, logs[tokens.place], number_of) + np.bincount(owner[seen], known.gains[place[hit]], number_of)
            id_bytes = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
            nulls = np.array(ids.is_null().to_pylist(), dtype=np.uint8).tobytes()
            block = _signed(xxhash.xxh3_64_intdigest(id_bytes + flat.tobytes()))
            yield _rows(_SENT, [(block % (word_parts + parts), block, _DOCS, id_bytes + nulls, pack(sums.ravel()))])
            for kind, wanted, sought, shift, number in ((_OF_WORD, ~common, flat, 0, word_parts), (_OF_PAIR, ~seen, pairs, word_parts, parts)):
                order = _by_place(tokens.place[wanted]) if kind == _OF_WORD else np.argsort(sought[wanted], kind="stable")
                sought, who = sought[wanted][order], owner[wanted][order]
                for p, here in by_part(sought, number):
                    yield _rows(_SENT, [(shift + p, block, kind, pack_sorted(sought[here]), pack(who[here]))])

    return map_arrow(docs, run, _SENT)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _lookup(sent: DataFrame, stored: DataFrame, hot) -> DataFrame:
    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        known: Hot = hot.value
        held = list(_each(right.to_batches()))
        keys = unpack_sorted(held[0][2]) if held else np.zeros(0, np.uint64)
        values = unpack(held[0][3], np.float32).astype(np.float64) if held else np.zeros(0)
        tokens = unpack(held[0][4], np.uint64).astype(np.float64) if held and held[0][4] else None
        out = []
        for _, block, kind, sent_keys, rows in _each(left.to_batches()):
            if kind == _DOCS:
                out.append((block, _DOCS, sent_keys, rows))
                continue
            sought, who = unpack_sorted(sent_keys), unpack(rows, np.uint32).astype(np.int64)
            at, hit = find(keys, sought)
            size = int(who.max()) + 1
            docs = np.flatnonzero(np.bincount(who, minlength=size))
            sums = np.zeros((len(docs), _WIDTH))
            if kind == _OF_WORD:
                found = np.zeros(len(sought))
                logs = np.full(len(sought), math.log10(known.unknown))
                if hit.any():
                    found[hit], logs[hit] = tokens[at[hit]], values[at[hit]]
                sums[:, 1] = np.bincount(who, found > 0, size)[docs]
                sums[:, 2] = np.bincount(who, known.base(found), size)[docs]
                sums[:, 3] = np.bincount(who, logs, size)[docs]
            else:
                sums[:, 3] = np.bincount(who[hit], values[at[hit]], size)[docs]
            out.append((block, kind, pack(docs.astype(np.uint32)), pack(sums.ravel())))
        return _table(_SUMMED, out)

    return sent.groupBy("part").cogroup(stored.groupBy("part")).applyInArrow(join, _SUMMED)


def _gather(summed: DataFrame, total: int) -> DataFrame:
    schema = "doc long, n_tokens long, n_known long, base_score double, score double"

    def add(group: pa.Table) -> pa.Table:
        rows = list(_each(group.to_batches()))
        own = [r for r in rows if r[1] == _DOCS]
        n = len(own[0][2]) // 9
        ids = np.frombuffer(own[0][2][: 8 * n], np.int64)
        nulls = np.frombuffer(own[0][2][8 * n :], np.uint8).astype(bool)
        sums = unpack(own[0][3], np.float64).reshape(-1, _WIDTH).copy()
        # Equal blocks (repeated rows) send the same sums, each of them as often as there are blocks.
        extra = np.zeros_like(sums)
        for _, kind, docs, more in rows:
            if kind != _DOCS:
                np.add.at(extra, unpack(docs, np.uint32).astype(np.int64), unpack(more, np.float64).reshape(-1, _WIDTH))
        sums += extra / len(own)
        out = [pa.array(ids, mask=nulls), *[pa.array(np.rint(sums[:, i]).astype(np.int64)) for i in (0, 1)], pa.array(sums[:, 2]), pa.array(sums[:, 3])]
        table = pa.table(out, names=["doc", "n_tokens", "n_known", "base_score", "score"])
        return pa.concat_tables([table] * len(own))

    return summed.groupBy("block").applyInArrow(add, schema).withColumn("train_tokens", F.lit(total).cast("long"))


def in_training(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 != 2, F.lit(True))


def learn(space: Workspace, texts: DataFrame, parts: int, word_parts: int) -> _Model:
    """A sampled model of the column text."""
    model = _Model(space, space.stage(count_pairs(texts, parts), "pairs"), word_parts)
    space.drop("pairs")
    model.sample()
    return model


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training=None) -> DataFrame:
    """(doc, n_tokens, n_known, base_score, score, train_tokens), one row per row of docs.

    training: a boolean column of docs that says which rows are learnt from. base_score is the add-one unigram
    log10 probability of the tokens, score the averaged log10 probability under the model.
    """
    space = Workspace(docs.sparkSession, "lm-score")
    training = in_training(id_col) if training is None else training
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), training.alias("training"))
    parts = min(MOST_PARTS, max(LEAST_PARTS, 2 * texts.rdd.getNumPartitions()))
    word_parts = max(LEAST_PARTS // 2, parts // PAIRS_TO_WORDS)
    model = learn(space, texts.filter("training").select("text"), parts, word_parts)
    words = model.words()
    gains = model.gains(words)
    space.drop(*[name for name, _ in model.sampled], f"state-{BURN_IN + SAMPLES}")
    hot = docs.sparkSession.sparkContext.broadcast(_hot(words, gains, model.unknown, model.totals))
    sent = _send(texts.select("doc", "text"), hot, word_parts, parts)
    return _gather(_lookup(sent, _stored(words, gains, word_parts), hot), model.totals.tokens)
