"""Stored full-text and substring index: immutable segments of postings that a refresh adds to and that are merged by level.

Files lie in blocks of at most BLOCK_FILES; within its block a file is a number. A block has one row for each term
(and for each three bytes in a row) with the numbers of the files that have it, so nothing is sent between tasks when
files are indexed, and a posting is a small number. Symbols lie in blocks of their own. A segment has the blocks of the
files that one refresh brought; the files that it replaces or takes away are its tombstones, which hold for all segments
before it. A search reads the rows of its own terms only; whether a text really has what was asked is checked on the
candidates that share all its byte triples. `fanout` segments of one level in a row are merged into one of the next,
their blocks packed anew without what is dead, so that a search meets few segments however often files change.

An index state is a list of segments, oldest first, as plain values: whoever keeps it (a snapshot) keeps reading the
same postings, whatever is added later.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as fn
from ..staging import file_system

FANOUT = 4
#: A block ends at so many files (symbols), bytes of text or words.
BLOCK_FILES, BLOCK_BYTES, BLOCK_WORDS = 4096, 16 << 20, 2_000_000
_FILE = ["repository_id", "path"]
#: Rows of a segment: files (symbols) with their numbers in a block; of each term or byte triple the numbers that have it.
_ROW = (
    "table string, term string, gram int, block long, nos array<int>, tfs array<int>, no int, repository_id string, path string, uid string, length int"
)
_TYPES = {
    "table": pa.string(), "term": pa.string(), "gram": pa.int32(), "block": pa.int64(), "nos": pa.list_(pa.int32()), "tfs": pa.list_(pa.int32()),
    "no": pa.int32(), "repository_id": pa.string(), "path": pa.string(), "uid": pa.string(), "length": pa.int32(),
}
_GONE = "repository_id string, path string"
#: The tables of postings, each with that of what its numbers are of.
_OF = {"terms": "files", "grams": "files", "symbol_grams": "symbols"}


def file_words() -> Column:
    """The words of a file as full-text search counts them."""
    text = fn.without_marks(F.lower(F.concat_ws(" ", "repository_id", "path", "content")))
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), 1)


def triples(text: bytes) -> set[int]:
    """All three bytes in a row, as numbers."""
    return {text[i] << 16 | text[i + 1] << 8 | text[i + 2] for i in range(len(text) - 2)}


def _rows(table: str, n: int, **columns) -> pa.RecordBatch:
    made = columns | {"table": pa.array([table]).take(pa.array(np.zeros(n, np.int64)))}
    return pa.RecordBatch.from_arrays([made[c].cast(t) if c in made else pa.nulls(n, t) for c, t in _TYPES.items()], names=list(_TYPES))


def _packed(table: str, block: int, key: str, values: pa.Array | None, codes: np.ndarray, nos: np.ndarray, tfs: np.ndarray | None = None) -> pa.RecordBatch:
    """One row a code with its numbers in order; values: what the codes stand for, if not for themselves."""
    order = np.argsort(codes << 32 | nos)
    codes, nos = codes[order], nos[order]
    begins = np.flatnonzero(np.diff(codes, prepend=-1))
    offsets = pa.array(np.append(begins, len(codes)), pa.int32())
    lists = {"nos": pa.ListArray.from_arrays(offsets, pa.array(nos, pa.int32()))}
    if tfs is not None:
        lists["tfs"] = pa.ListArray.from_arrays(offsets, pa.array(tfs[order], pa.int32()))
    keys = pa.array(codes[begins])
    return _rows(table, len(begins), **{key: keys if values is None else values.take(keys)}, block=pa.array(np.full(len(begins), block)), **lists)


def _new_block() -> int:
    return int.from_bytes(os.urandom(8), "big") >> 1


def _counted(block: int, words: pa.ListArray) -> tuple[np.ndarray, pa.RecordBatch]:
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    nos = np.repeat(np.arange(len(words), dtype=np.int64), lengths)
    found, times = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) << 32 | nos, return_counts=True)
    return lengths, _packed("terms", block, "term", coded.dictionary, found >> 32, found & 0xFFFFFFFF, times)


def _triples_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(triple, number of the text), once each."""
    out = []
    for begin in range(0, len(texts), 256):
        part = texts.slice(begin, 256)
        _, offsets, data = part.buffers()
        bounds = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1]
        raw = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]].astype(np.int64)
        if len(raw) < 3:
            continue
        row = np.repeat(np.arange(begin, begin + len(part), dtype=np.int64), np.diff(bounds))
        whole = row[:-2] == row[2:]
        out.append(np.unique(((row[:-2] << 24) | (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:])[whole]))
    keys = np.concatenate(out) if out else np.empty(0, np.int64)
    return keys & 0xFFFFFF, keys >> 24


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of a bounded size; the column `text` tells how much is in them."""
    held, rows, size = [], 0, 0
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            held.append(part)
            rows += part.num_rows
            size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if rows >= BLOCK_FILES or size >= BLOCK_BYTES:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _whole(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


def _index_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held in _blocks(batches):
        block, n = _new_block(), held.num_rows
        lengths, counted = _counted(block, _whole(held["words"]))
        yield _rows("files", n, block=pa.array(np.full(n, block)), no=pa.array(np.arange(n)), length=pa.array(lengths), **{c: _whole(held[c]) for c in _FILE})
        yield counted
        yield _packed("grams", block, "gram", None, *_triples_of(_whole(held["text"]).cast(pa.large_binary())))


def _index_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held in _blocks(batches):
        block, n = _new_block(), held.num_rows
        yield _rows("symbols", n, block=pa.array(np.full(n, block)), no=pa.array(np.arange(n)), **{c: _whole(held[c]) for c in (*_FILE, "uid")})
        yield _packed("symbol_grams", block, "gram", None, *_triples_of(_whole(held["text"]).cast(pa.large_binary())))


def _pack_again(postings: pa.Table, owners: pa.Table) -> pa.Table:
    """Several blocks as one: owners are what lives of them; postings of anything else go."""
    block, n, table = _new_block(), owners.num_rows, owners["table"][0].as_py() if owners.num_rows else ""
    out = []
    if n:
        out.append(_rows(table, n, block=pa.array(np.full(n, block)), no=pa.array(np.arange(n)), **{c: _whole(owners[c]) for c in (*_FILE, "uid", "length")}))
        # Where a number of an old block is now: old blocks lie one after the other in one list.
        blocks, at = np.unique(owners["block"].to_numpy(), return_inverse=True)
        nos = owners["no"].to_numpy().astype(np.int64)
        sizes = np.zeros(len(blocks), np.int64)
        np.maximum.at(sizes, at, nos + 1)
        base = np.cumsum(sizes) - sizes
        now = np.full(sizes.sum(), -1, np.int64)
        now[base[at] + nos] = np.arange(n)
    for name, key in (("terms", "term"), ("grams", "gram"), ("symbol_grams", "gram")):
        part = postings.filter(pc.equal(postings["table"], name)) if n else postings.slice(0, 0)
        if not part.num_rows:
            continue
        lists = _whole(part["nos"])
        row = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy())
        of = np.searchsorted(blocks, part["block"].to_numpy())[row]
        old = lists.flatten().to_numpy().astype(np.int64)
        new = np.where(old < sizes[of], now[np.minimum(base[of] + old, len(now) - 1)], -1)
        lives = new >= 0
        values = _whole(part[key]).dictionary_encode()
        codes = values.indices.to_numpy().astype(np.int64)[row]
        tfs = _whole(part["tfs"]).flatten().to_numpy()[lives] if name == "terms" else None
        out.append(_packed(name, block, key, values.dictionary, codes[lives], new[lives], tfs))
    return pa.Table.from_batches(out, schema=pa.schema(list(_TYPES.items())))


class TextIndex:
    """Segments below a folder of any file system that Spark reads. A state names those that count, oldest first."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT):
        self.spark, self.root, self.fanout = spark, root.rstrip("/"), max(2, fanout)

    def _write_gone(self, name: str, gone: DataFrame) -> int:
        gone.select(*_FILE).distinct().write.option("compression", "zstd").parquet(f"{self.root}/{name}/gone")
        return self.spark.read.schema(_GONE).parquet(f"{self.root}/{name}/gone").count()

    def _each(self, state: list[dict], folder: str, schema: str) -> DataFrame:
        out = None
        for segment in state:
            rows = self.spark.read.schema(schema).parquet(f"{self.root}/{segment['name']}/{folder}").withColumn("number", F.lit(segment["number"]))
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], schema + ", number int") if out is None else out

    def table(self, state: list[dict], *tables: str) -> DataFrame:
        """The rows of these tables in all segments with the number of their segment, dead ones too."""
        return self._each(state, "rows", _ROW).filter(F.col("table").isin(*tables))

    def live(self, state: list[dict], rows: DataFrame) -> DataFrame:
        """Those rows of files or symbols whose file no later segment has replaced."""
        if not any(s["tombstones"] for s in state):
            return rows
        gone = self._each([s for s in state if s["tombstones"]], "gone", _GONE).withColumnRenamed("number", "since").alias("gone")
        mine = rows.alias("mine")
        same = (F.col("mine.repository_id") == F.col("gone.repository_id")) & (F.col("mine.path") == F.col("gone.path"))
        return mine.join(gone, same & (F.col("mine.number") < F.col("gone.since")), "left_anti")

    def _totals(self, files: DataFrame) -> tuple[int, int]:
        row = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        return row[0], row[1]

    def add(self, state: list[dict], files: DataFrame, symbols: DataFrame | None = None, gone: DataFrame | None = None) -> list[dict]:
        """The state with a segment of these files, and of the symbols in them; gone: (repository_id, path) that older segments lose."""
        name = f"segment-{uuid.uuid4().hex[:16]}"
        # A table of few large pieces is dealt over all tasks before its texts are read.
        lowered = F.lower(F.coalesce("content", F.lit(""))).alias("text")
        rows = self._dealt(files.select(*_FILE, "content")).select(*_FILE, file_words().alias("words"), lowered).mapInArrow(_index_files, _ROW)
        if symbols is not None:
            named = self._dealt(symbols.select(*_FILE, "uid", F.lower(F.coalesce("name", F.lit(""))).alias("text")))
            rows = rows.unionByName(named.mapInArrow(_index_symbols, _ROW))
        made = {"name": name, "number": state[-1]["number"] + 1 if state else 0, "level": 0, "tombstones": 0, "dead_files": 0, "dead_tokens": 0}
        made |= self._store(made, rows)
        if state and gone is not None:
            made["tombstones"] = self._write_gone(name, gone)
            tombs = self._each([made], "gone", _GONE).select(*_FILE)
            made |= dict(zip(("dead_files", "dead_tokens"), self._totals(self.live(state, self.table(state, "files")).join(tombs, _FILE, "left_semi"))))
        return self._merged([*state, made])

    def _dealt(self, rows: DataFrame) -> DataFrame:
        tasks = self.spark.sparkContext.defaultParallelism
        return rows if rows.rdd.getNumPartitions() >= 2 * tasks else rows.repartition(2 * tasks)

    def _store(self, segment: dict, rows: DataFrame) -> dict:
        rows.sortWithinPartitions("table", "term", "gram").write.partitionBy("table").option("compression", "zstd").parquet(f"{self.root}/{segment['name']}/rows")
        return dict(zip(("n_files", "n_tokens"), self._totals(self.table([segment], "files"))))

    def _merged(self, state: list[dict]) -> list[dict]:
        """As long as the last `fanout` segments have one level, they become one of the next."""
        while len(state) >= self.fanout and len({s["level"] for s in state[-self.fanout :]}) == 1:
            rest, group = state[: -self.fanout], state[-self.fanout :]
            made = {"name": f"segment-{uuid.uuid4().hex[:16]}", "number": group[-1]["number"], "level": group[0]["level"] + 1, "tombstones": 0}
            made |= self._store(made, self._together(group))
            told = [s for s in group if s["tombstones"]]
            if rest and told:  # tombstones are for older segments only
                made["tombstones"] = self._write_gone(made["name"], self._each(told, "gone", _GONE))
            for what, own in (("dead_files", "n_files"), ("dead_tokens", "n_tokens")):
                made[what] = sum(s[what] for s in group) - (sum(s[own] for s in group) - made[own])
            state = [*rest, made]
        return state

    def _together(self, group: list[dict]) -> DataFrame:
        """The rows of one segment instead of these, in blocks as full as may be."""
        owners = self.live(group, self.table(group, "files", "symbols"))
        # One row a block; a segment has one for thousands of files.
        sizes = owners.groupBy("table", "number", "block").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words"))
        placed, to, before, n, words = [], 0, None, 0, 0
        for row in sizes.orderBy("table", "number", "block").collect():
            if row["table"] != before or n + row["n"] > BLOCK_FILES or words + row["words"] > BLOCK_WORDS:
                to, n, words, before = to + 1, 0, 0, row["table"]
            n, words = n + row["n"], words + row["words"]
            placed.append((row["block"], to))
        if not placed:
            return self.spark.createDataFrame([], _ROW)
        where = lambda: F.broadcast(self.spark.createDataFrame(placed, "block long, to int"))
        postings, held = (x.join(where(), "block").select("to", *_TYPES) for x in (self.table(group, *_OF), owners))
        return postings.groupBy("to").cogroup(held.groupBy("to")).applyInArrow(_pack_again, _ROW)

    def postings(self, state: list[dict], terms: list[str]) -> DataFrame:
        """(term, repository_id, path, tf, length) of the terms; pages of files without them are not read."""
        rows = self.table(state, "terms").filter(F.col("term").isin(*terms)) if terms else self.table([], "terms")
        each = rows.select("term", "number", "block", F.explode(F.arrays_zip("nos", "tfs")).alias("p")).select("term", "number", "block", F.col("p.nos").alias("no"), F.col("p.tfs").alias("tf"))
        files = self.live(state, self.table(state, "files")).select("number", "block", "no", *_FILE, "length")
        return each.join(files, ["number", "block", "no"]).select("term", *_FILE, "tf", "length")

    def totals(self, state: list[dict]) -> tuple[int, int]:
        """Files and words that count, from the state alone."""
        return tuple(sum(s[n] - s[d] for s in state) for n, d in (("n_files", "dead_files"), ("n_tokens", "dead_tokens")))

    def having(self, state: list[dict], asked: dict[int, set[int]], table: str = "grams") -> DataFrame:
        """(query_no, and the keys of the table) of what has all byte triples that a query asks for; a query asks for one at least."""
        pairs = [(q, g) for q, grams in asked.items() for g in sorted(grams)]
        wanted = self.spark.createDataFrame(pairs, "query_no int, gram int")
        sizes = self.spark.createDataFrame([(q, len(g)) for q, g in asked.items()], "query_no int, needed int")
        rows = self.table(state, table).filter(F.col("gram").isin(*sorted({g for _, g in pairs})))
        # At most MOST_QUERIES short texts. A group is the lists of one block.
        met = rows.join(F.broadcast(wanted), "gram").groupBy("query_no", "number", "block").agg(F.collect_list("nos").alias("lists"))
        met = met.join(F.broadcast(sizes), "query_no").filter(F.size("lists") == F.col("needed"))
        both = F.aggregate(F.slice("lists", 2, F.size("lists")), F.get("lists", F.lit(0)), lambda a, b: F.array_intersect(a, b))
        met = met.select("query_no", "number", "block", F.explode(both).alias("no"))
        keys = _FILE if table == "grams" else [*_FILE, "uid"]
        owners = self.live(state, self.table(state, _OF[table])).select("number", "block", "no", *keys)
        return met.join(owners, ["number", "block", "no"]).select("query_no", *keys).distinct()

    def names(self, state: list[dict]) -> set[str]:
        return {s["name"] for s in state}

    def drop_others(self, states: list[list[dict]]) -> None:
        """Deletes the segments that none of the states names."""
        kept = set().union(*(self.names(s) for s in states)) if states else set()
        at, files = file_system(self.spark, self.root)
        if files.exists(at):
            for found in files.listStatus(at):
                if found.getPath().getName() not in kept:
                    files.delete(found.getPath(), True)
