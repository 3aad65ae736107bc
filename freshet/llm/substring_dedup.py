"""Substring dedup by relative Lempel-Ziv parsing over an index of reference blocks.

Every document is a reference. It is cut into *blocks* where its content says so: each
window of ``min_words`` words picks the least hash among its ``ANCHOR_WORDS``-word runs
(its anchor), and a block is a maximal row of windows with one anchor. Equal windows
pick equal anchors, so a repeated passage is cut the same way wherever it stands. The
index maps each block's content to the place where it starts first.

A document is then parsed greedily from the left into factors (start, length, reference
document, start there). A block that the index knows from an earlier place is copied
from there. Blocks that are not copied as a whole end a factor, but it may still reach into
them, or a shorter one lie inside: that can be only where some other block has the same
anchor, and there each window has its own first place, by which factors go on word by word.
A factor goes on as long as the next place in its reference is the first place of what
follows; where another factor begins before it ends, the later one gives way and begins
at that boundary. Every window that straddles a boundary of two factors is copied too, as it
belongs to one of the copies that were joined there, so all words of factors are duplicate
spans. Words outside of factors are literals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm import wordhash as wh
from freshet.llm.common import discard, materialise, restored, stowed

ANCHOR_WORDS = 6


def _lesser(values: np.ndarray, places: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    left = values[:-shift] <= values[shift:]
    return np.where(left, values[:-shift], values[shift:]), np.where(left, places[:-shift], places[shift:])


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value (the leftmost of equals) in every window of ``width``."""
    places, span = np.arange(len(values)), 1
    while span * 2 <= width:
        values, places = _lesser(values, places, span)
        span *= 2
    return _lesser(values, places, width - span)[1] if span < width else places


class Blocks:
    """The windows and blocks of a slice of rows, as arrays."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, min_words: int, anchor_words: int):
        self.hashes, self.first, self.min_words = hashes, first, min_words
        n = max(len(hashes) - min_words + 1, 0)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        inside = row[:n] == row[min_words - 1 : min_words - 1 + n]
        #: start of each window among all words, and its row
        self.window = np.flatnonzero(inside)
        self.window_row = row[self.window]
        if not len(self.window):
            empty = np.zeros(0, np.int64)
            self.start, self.count, self.row, self.anchor, self.content = empty, empty, empty, empty, empty
            return
        keys = wh.runs(hashes, anchor_words)
        anchor = _leftmost_least(wh.mix(keys), min_words - anchor_words + 1)[self.window]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (self.window_row[1:] != self.window_row[:-1])
        #: a block: index of its first window, number of windows, row, hash of anchor, hash of content
        self.start = np.flatnonzero(new)
        self.count = np.diff(np.append(self.start, len(anchor)))
        self.row = self.window_row[self.start]
        self.anchor = keys[anchor[self.start]].view(np.int64)
        low = self.window[self.start]
        high = low + self.count + min_words - 1
        up, down = wh._powers(2, len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
        self.content = wh.mix((sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64)).view(np.int64)

    def place(self) -> np.ndarray:
        """Word at which each block starts in its document."""
        return (self.window[self.start] - self.first[self.row]).astype(np.int32)

    def window_place(self) -> np.ndarray:
        return (self.window - self.first[self.window_row]).astype(np.int32)


def _blocks(column: pa.Array, min_words: int, anchor_words: int) -> Iterator[tuple[int, int, Blocks]]:
    for a, b in wh.slices(column):
        yield a, b, Blocks(*wh.word_hashes(column, a, b), min_words, anchor_words)


def find_factors(docs: DataFrame, min_words: int = 20, anchor_words: int = ANCHOR_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Parse every document: the columns of ``docs`` with ``n_words``, ``n_removed`` (long),
    ``factors`` (array of (start, length, ref_id, ref_start) in words: those words are the
    reference document's at ref_start, an earlier place; in order, without overlap),
    ``spans`` (array of (start, length): the factors, joined where they touch) and
    ``kept_text`` (the words outside spans, joined by one space). Columns of those names in
    ``docs`` are replaced.

    A word belongs to a span if a window of ``min_words`` over it repeats a window that starts in a
    document of smaller id, or earlier in the same one; windows are those of the input.
    The first factor of a span has ``min_words`` at least, one that continues it may be shorter.

    Edge cases: a null or empty text, or one of fewer than ``min_words`` words, has no
    span. A row with a null id is neither reference nor parsed: it keeps all its words.
    Rows that repeat an id are one document: equal texts among them keep what a single
    row would. An empty table gives an empty table.

    At scale: one row per block (about one per seven words) is grouped by content with
    map-side combine, so copies of a passage fold into one first place. What comes back
    to a document is the list of blocks that stand there first; only those that don't, and
    windows of blocks that share an anchor with different content (few), are looked up.
    They get their first places from the repeated blocks and windows by one plain shuffle join,
    which adaptive execution splits on a hot passage, and return as a list by document;
    no group of copies is ever gathered. Texts are shuffled once, by id; both later reads
    use that shuffle.
    """
    anchor_words = min(anchor_words, min_words)
    docs, back = stowed(docs, [id_col, text_col], [id_col, text_col, "n_words", "n_removed", "factors", "spans", "kept_text"])
    base = docs.withColumnsRenamed({id_col: "_id", text_col: "_text"})
    id_type = base.schema["_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, ids = wh.fill(batch.column("_text")), batch.column("_id")
            for a, _, x in _blocks(column, min_words, anchor_words):
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(x.row + a)), pa.array(x.place(), pa.int32()), pa.array(x.anchor, pa.int64()), pa.array(x.content, pa.int64())],
                    names=["_id", "_at", "_anchor", "_content"],
                )

    schema = T.StructType([T.StructField("_id", id_type), T.StructField("_at", T.IntegerType()), T.StructField("_anchor", T.LongType()), T.StructField("_content", T.LongType())])
    blocks = base.where(F.col("_id").isNotNull()).select("_id", "_text").mapInArrow(cut, schema)
    index = blocks.groupBy("_anchor", "_content").agg(F.min(F.struct("_id", "_at")).alias("_f"), F.count("*").alias("_n"))
    index = index.select("_anchor", "_f._id", "_f._at", F.when(F.col("_n") > 1, F.col("_content")).alias("_again"))  # content where it repeats
    index = materialise(index, "blocks")
    shared = materialise(index.groupBy("_anchor").agg(F.count("*").alias("_n")).where("_n > 1").select("_anchor", F.lit(1).alias("_open")), "anchors")
    # Of a document: twice the start of each block that is first there, plus 1 if its windows are to be looked up.
    own = (
        index.join(shared, "_anchor", "left")
        .select("_id", (F.col("_at").cast("long") * 2 + F.coalesce("_open", F.lit(0))).alias("_b"))
        .groupBy("_id").agg(F.collect_list("_b").alias("_first_blocks"))
        .withColumnRenamed("_id", "_own_id")
    )
    own = materialise(own, "own")
    repeated = index.where("_again IS NOT NULL").select(F.lit(True).alias("_block"), F.col("_anchor").alias("_k1"), F.col("_again").alias("_k2"), F.struct("_id", "_at").alias("_f"))
    repeated = materialise(repeated, "repeated")
    discard(index, shared)
    joined = base.join(own, F.col("_id") == F.col("_own_id"), "left").drop("_own_id")

    def listed(batch: pa.RecordBatch, a: int, b: int, name: str) -> tuple[np.ndarray, np.ndarray]:
        """The lists of rows a..b, flat, as (row, value)."""
        part = batch.column(name).slice(a, b - a)
        sizes = np.asarray(part.value_lengths().fill_null(0), np.int64)
        return np.repeat(np.arange(b - a), sizes), np.asarray(part.flatten(), np.int64)

    def find(rows: np.ndarray, places: np.ndarray, in_rows: np.ndarray, in_places: np.ndarray) -> np.ndarray:
        """Index of each (row, place) among the (ascending) rows and places given, or -1."""
        have, want = in_rows * 2**32 + in_places, rows * 2**32 + places
        at = np.minimum(np.searchsorted(have, want), max(len(have) - 1, 0))
        return np.where(have[at] == want, at, -1) if len(have) else np.full(len(want), -1)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks that don't stand here first, and windows of open blocks that do."""
        for batch in batches:
            column, ids = wh.fill(batch.column("_text")), batch.column("_id")
            known = np.asarray(ids.is_valid())
            for a, b, x in _blocks(column, min_words, anchor_words):
                rows, value = listed(batch, a, b, "_first_blocks")
                at = find(rows, value // 2, x.row, x.place())
                copied = known[a:b][x.row]
                copied[at[at >= 0]] = False
                copied = np.flatnonzero(copied)
                at = np.unique(at[(at >= 0) & (value % 2 == 1)])
                counts = x.count[at]
                w = np.repeat(x.start[at] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                starts = x.window[w]
                one = wh.runs(x.hashes, min_words)[starts].view(np.int64)
                two = wh.runs(wh.mix(x.hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), min_words)[starts].view(np.int64)
                whole = np.arange(len(w) + len(copied)) >= len(w)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.concatenate([x.window_row[w], x.row[copied]]) + a)), pa.array(np.concatenate([x.window_place()[w], x.place()[copied]]), pa.int32()), pa.array(whole),
                     pa.array(np.concatenate([one, x.anchor[copied]]), pa.int64()), pa.array(np.concatenate([two, x.content[copied]]), pa.int64())],
                    names=["_id", "_at", "_block", "_k1", "_k2"],
                )

    schema = T.StructType([T.StructField("_id", id_type), T.StructField("_at", T.IntegerType()), T.StructField("_block", T.BooleanType()), T.StructField("_k1", T.LongType()), T.StructField("_k2", T.LongType())])
    units = materialise(joined.mapInArrow(look_up, schema), "units")
    windows = units.where(~F.col("_block")).groupBy("_k1", "_k2").agg(F.min(F.struct("_id", "_at")).alias("_f"), F.count("*").alias("_n")).where("_n > 1")
    firsts = repeated.union(windows.select(F.lit(False), "_k1", "_k2", "_f"))
    sources = (
        units.join(firsts, ["_block", "_k1", "_k2"]).where(F.struct("_id", "_at") != F.col("_f"))
        .groupBy("_id").agg(F.collect_list(F.struct("_at", "_block", F.col("_f._id").alias("ref"), F.col("_f._at").alias("from"))).alias("_sources"))
        .withColumnRenamed("_id", "_s_id")
    )
    parsed = base.join(sources, F.col("_id") == F.col("_s_id"), "left").drop("_s_id")

    fields = base.schema.fields
    factor = T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("ref_id", id_type), T.StructField("ref_start", T.IntegerType()),
    ]))
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))
    out_schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("factors", factor), T.StructField("spans", span), T.StructField("kept_text", T.StringType())])

    def greedy(x: Blocks, rows: np.ndarray, entries: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end, entry, start in the reference) of the factors; start and end
        among all words of the slice."""
        at, whole, start = (np.asarray(entries.field(c)) for c in ("_at", "_block", "from"))
        ref = np.asarray(entries.field("ref").dictionary_encode().indices)
        source = np.full(len(x.window), -1)
        place = np.zeros(len(x.window), np.int64)
        single = find(rows[~whole], at[~whole], x.window_row, x.window_place())
        source[single[single >= 0]] = np.flatnonzero(~whole)[single >= 0]
        place[single[single >= 0]] = start[~whole][single >= 0]
        blocks = find(rows[whole], at[whole], x.row, x.place())
        entry, blocks = np.flatnonzero(whole)[blocks >= 0], blocks[blocks >= 0]
        counts = x.count[blocks]
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        w = np.repeat(x.start[blocks], counts) + step
        source[w], place[w] = np.repeat(entry, counts), np.repeat(start[entry], counts) + step
        w = np.flatnonzero(source >= 0)
        if not len(w):
            return w, w, w, w, w
        goes_on = (x.window[w[1:]] == x.window[w[:-1]] + 1) & (ref[source[w[1:]]] == ref[source[w[:-1]]]) & (place[w[1:]] == place[w[:-1]] + 1) & (x.window_row[w[1:]] == x.window_row[w[:-1]])
        first, last = w[np.append(True, ~goes_on)], w[np.append(~goes_on, True)]
        row, begin, end = x.window_row[first], x.window[first], x.window[last] + min_words
        free = begin.copy()
        free[1:] = np.where(row[1:] == row[:-1], np.maximum(begin[1:], end[:-1]), begin[1:])
        return row, free, end, source[first], place[first] + free - begin

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = wh.fill(batch.column("_text"))
            for a, b, x in _blocks(column, min_words, anchor_words):
                part = batch.column("_sources").slice(a, b - a)
                entries = part.flatten()
                row, start, end, entry, there = greedy(x, np.repeat(np.arange(b - a), np.asarray(part.value_lengths().fill_null(0), np.int64)), entries)
                factors = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(row, np.arange(b - a + 1)), pa.int32()),
                    pa.StructArray.from_arrays(
                        [pa.array(start - x.first[row], pa.int32()), pa.array(end - start, pa.int32()), entries.field("ref").take(pa.array(entry)), pa.array(there, pa.int32())],
                        names=["start", "length", "ref_id", "ref_start"]),
                )
                cover = np.zeros(len(x.hashes) + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, end, -1)
                gone = np.cumsum(cover)[:-1] > 0
                texts, spans, removed = [], [], []
                for r in range(b - a):
                    lo, hi = x.first[r], x.first[r + 1]
                    mine = gone[lo:hi]
                    words = _split(column[a + r].as_py())
                    n = int(mine.sum())
                    removed.append(n)
                    if n:
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]])))
                        spans.append([{"start": int(s), "length": int(e - s)} for s, e in edge.reshape(-1, 2)])
                        words = [w for w, m in zip(words, mine.tolist(), strict=True) if not m]
                    else:
                        spans.append([])
                    texts.append(" ".join(words))
                part = batch.slice(a, b - a)
                columns = {f.name: part.column(f.name) for f in fields}
                columns["n_words"] = pa.array(np.diff(x.first), pa.int64())
                columns["n_removed"] = pa.array(removed, pa.int64())
                columns["factors"] = factors
                columns["spans"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))
                columns["kept_text"] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return restored(parsed.mapInArrow(parse, out_schema), {"_id": id_col, "_text": text_col, **back})


_ASCII_SPACES = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))


def _split(text: str) -> list[str]:
    return [w for w in text.translate(_ASCII_SPACES).split(" ") if w]
