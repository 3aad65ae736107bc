"""Source divergence audit: how far the sources of a language lie apart in their terms.

A byte-level tokenizer works on the concatenated UTF-8 buffer of a batch: a lookup table
tells letters, boundaries come from comparing neighbours, xxhash groups the slices and
every slice is compared byte by byte with the first of its group. Counts then meet by
language and block of terms as CSR matrices (a row a source, a column a term), whose
integer divergences are sums over segments by ``reduceat``; divergences are sums over
terms, so the blocks' parts just add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import materialise

#: Bytes of text that are taken at once, about.
CHUNK = 1 << 23
#: Blocks of terms a language at least, and counts of a block, about.
LEAST_BLOCKS, ENTRIES = 64, 50_000
#: Elements of the largest matrix that is built at once.
TILE = 1 << 21

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = _LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def find_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every term in the texts that lie between ``offsets`` of ``data``."""
    letter = _LETTER[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = False, False
    starts = np.flatnonzero(letter & ~before)
    return starts, np.flatnonzero(letter & ~after) + 1, np.searchsorted(offsets, starts, "right") - 1


def group_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(group of every slice, a slice of every group): equal bytes and nothing else are one group.

    Slices meet by hash; all bytes of a slice are compared with those of the first of its hash,
    and slices that differ there are grouped by their bytes.
    """
    raw = data.tobytes()
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    lengths, like = ends - starts, first[group]
    alike = lengths == lengths[like]
    for a in range(0, len(starts), TILE // 8):  # in parts: what is gathered is as long as the slices
        rows = a + np.flatnonzero(alike[a : a + TILE // 8])
        n = lengths[rows]
        if not len(rows):
            continue
        at = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(at, n)
        same = data[np.repeat(starts[rows], n) + step] == data[np.repeat(starts[like[rows]], n) + step]
        alike[rows] = np.logical_and.reduceat(same, at)
    if not alike.all():
        more: dict[bytes, int] = {}
        extra = []
        for k in np.flatnonzero(~alike).tolist():
            word = raw[starts[k] : ends[k]]
            if word not in more:
                more[word] = len(first) + len(extra)
                extra.append(k)
            group[k] = more[word]
        first = np.concatenate([first, np.array(extra, first.dtype)])
    return group, first


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of the values of each."""
    if not len(keys):
        return keys, *(v[:0] for v in values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], *(np.add.reduceat(v[order], at) for v in values)


def count_chunk(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(owner, term, occurrences, texts) for texts of a chunk; ``owner`` is the group of each text."""
    data = _LOWER[data]
    starts, ends, text = find_terms(data, offsets)
    group, first = group_slices(data, starts, ends)
    pairs, n = _sums(text * max(len(first), 1) + group, np.ones(len(starts), np.int64))
    text, term = np.divmod(pairs, max(len(first), 1))
    keys, n, texts = _sums(owner[text] * max(len(first), 1) + term, n, np.ones(len(pairs), np.int64))
    by, term = np.divmod(keys, max(len(first), 1))
    raw, at, to = data.tobytes(), starts[first].tolist(), ends[first].tolist()
    words = [raw[a:b] for a, b in zip(at, to, strict=True)]
    return by, [words[t] for t in term.tolist()], n, texts


def count_long(data: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(term, occurrences) of one long text, in parts that end where a term does."""
    found: dict[bytes, int] = {}
    a = 0
    while a < len(data):
        b = min(a + CHUNK, len(data))
        while b < len(data) and _LETTER[data[b]]:
            b += 1
        _, words, n, _ = count_chunk(data[a:b], np.array([0, b - a]), np.zeros(1, np.int64))
        for word, k in zip(words, n.tolist(), strict=True):
            found[word] = found.get(word, 0) + k
        a = b
    return list(found), np.array(list(found.values()), np.int64)


COUNTS = "lang string, source string, term string, n long, docs long"


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs) with the occurrences and documents of every term, and a row of
    the empty term for every (lang, source), whose docs are all of its documents.

    Texts are counted a few MB at a time and summed map-side; a text longer than that goes in
    parts. Nothing is kept from batch to batch. Nulls count as empty.
    """
    slim = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def rows(names: list[tuple[str, str]], by, words: list[bytes], n, texts) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "lang": pa.array([names[i][0] for i in by], pa.string()), "source": pa.array([names[i][1] for i in by], pa.string()),
            "term": pa.array(words, pa.binary()).cast(pa.string()), "n": pa.array(n, pa.int64()), "docs": pa.array(texts, pa.int64()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.large_string())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            places: dict[tuple[str, str], int] = {}
            owner = np.array([places.setdefault(g, len(places)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)], np.int64)
            names = list(places)
            yield rows(names, range(len(names)), [b""] * len(names), np.zeros(len(names), np.int64), np.bincount(owner, minlength=len(names)))
            at = 0
            while at < len(text):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
                part = data[offsets[at] : offsets[to]]
                if to == at + 1 and len(part) > CHUNK:
                    words, n = count_long(part)
                    yield rows(names, [owner[at]] * len(words), words, n, np.ones(len(words), np.int64))
                elif len(part):
                    by, words, n, texts = count_chunk(part, offsets[at : to + 1] - offsets[at], owner[at:to])
                    yield rows(names, by.tolist(), words, n, texts)
                at = to

    return slim.mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / total), exact: long division by digits of base 1000."""
    if total >= 2**63 // 1000:
        raise OverflowError("more than 9e15 occurrences of terms in one language")
    rest, out = counts.astype(np.int64) + 2, np.zeros(counts.shape, np.int64)
    for _ in range(3):
        whole, rest = np.divmod(rest, total)
        out = (out + whole) * 1000
        rest = rest * 1000
    return out + rest // total + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Csr:
    """Shares of sources (rows) in the terms of a block (columns); what isn't held is the row's share for no occurrence."""

    def __init__(self, row: np.ndarray, column: np.ndarray, count: np.ndarray, totals: np.ndarray, columns: int):
        order = np.lexsort((column, row))
        self.indices, self.columns = column[order], columns
        self.indptr = np.searchsorted(row[order], np.arange(len(totals) + 1))
        self.counts = count[order]
        self.data = np.concatenate([np.zeros(0, np.int64), *(shares(self.counts[a:b], t) for a, b, t in zip(self.indptr[:-1], self.indptr[1:], totals.tolist(), strict=True))])
        self.none = np.array([shares(np.zeros(1, np.int64), t)[0] for t in totals.tolist()], np.int64)

    def segments(self, values: np.ndarray, first: int) -> np.ndarray:
        """Sums of ``values``, which lie along the data of the rows from ``first`` on, by row."""
        bounds = self.indptr[first:] - self.indptr[first]
        out, held = np.zeros(len(bounds) - 1, np.int64), bounds[1:] > bounds[:-1]
        if held.any():
            out[held] = np.add.reduceat(values, bounds[:-1][held])
        return out

    def apart(self, i: int) -> np.ndarray:
        """Divergences of row i from each later row, summed over all columns."""
        own = slice(self.indptr[i], self.indptr[i + 1])
        p = np.full(self.columns, self.none[i])
        p[self.indices[own]] = self.data[own]
        later = slice(self.indptr[i + 1], None)
        none = self.none[i + 1 :]
        there = p[self.indices[later]]
        # where the later row has the term, less what the sums below count for those columns
        out = self.segments(divergence(there, self.data[later]) - divergence(there, np.repeat(none, np.diff(self.indptr[i + 1 :]))), i + 1)
        out += (self.columns - (own.stop - own.start)) * divergence(self.none[i], none)
        step = max(1, TILE // max(len(none), 1))
        for a in range(own.start, own.stop, step):
            out += divergence(self.data[a : min(a + step, own.stop), None], none[None, :]).sum(0)
        return out


PARTS = "lang string, part string, source string, item string, value long"


def block_parts(key: tuple, entries: pa.Table, groups: pa.Table, top: int) -> Iterator[pa.RecordBatch]:
    """Of one language and block of terms: divergences of each pair of sources summed over the block
    (the smaller source first), and each source's best terms."""
    lang, block = key[0].as_py(), key[1].as_py()
    held = sorted(zip(groups["source"].to_pylist(), groups["total"].to_pylist(), strict=True), key=lambda g: g[0].encode())
    names = [g[0] for g in held]
    if not entries.num_rows and block:
        return
    totals = np.array([g[1] for g in held], np.int64)
    terms = sorted(set(entries["term"].to_pylist()), key=str.encode)
    at, column = {s: k for k, s in enumerate(names)}, {t: k for k, t in enumerate(terms)}
    row = np.array([at[s] for s in entries["source"].to_pylist()], np.int64)
    col = np.array([column[t] for t in entries["term"].to_pylist()], np.int64)
    count = np.array(entries["n"].to_pylist(), np.int64)
    if entries.num_rows:
        csr = Csr(row, col, count, totals, len(terms))

    def batch(part: str, sources: list[str], items: list[str], values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(items), pa.string()), "part": pa.array([part] * len(items), pa.string()), "source": pa.array(sources, pa.string()), "item": pa.array(items, pa.string()), "value": pa.array(values, pa.int64())})

    for i, name in enumerate(names):
        rest = names[i + 1 :]
        yield batch("pair", [name] * len(rest), rest, csr.apart(i) if entries.num_rows else np.zeros(len(rest), np.int64))
    if not entries.num_rows:
        return
    whole = shares(_sums(csr.indices, csr.counts)[1], groups["lang_total"][0].as_py())  # every column is held by some source
    for i, name in enumerate(names):
        own = slice(csr.indptr[i], csr.indptr[i + 1])
        p, q = csr.data[own], whole[csr.indices[own]]
        over = np.flatnonzero(p > q)
        value = divergence(p[over], q[over])
        best = np.argsort(-value, kind="stable")[:top]  # columns ascend, so ties do as well
        yield batch("term", [name] * len(best), [terms[c] for c in csr.indices[own][over[best]].tolist()], value[best])


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: how far every source of a language lies from each
    other one (``pair``), and the terms that it has more of than the language (``term``, the ``top`` best).

    Terms are runs of letters A-Z, a-z and all characters beyond ASCII, with A-Z lower-cased; a
    language keeps those in ``min_docs`` of its documents. A share is p = 1 + floor(10^9 (count + 2)
    / (N + 2 V)) over its V kept terms with N occurrences, and a divergence floor((p - q)^2 / (p + q)).
    Ranks go by value, descending, then by the item's UTF-8 bytes.

    Edge cases: a null text, language or source counts as empty; each row is a document, repeated
    rows too. A source without terms takes part with shares for no occurrence; where a language keeps no
    term, all its divergences are 0; a language of one source has no pairs. Other columns aren't read. An
    empty table gives an empty table.

    At scale: the texts are read once and never shuffled. Counts combine map-side, so a source with a
    third of all rows is a partial count in every task. A block of terms (by hash, some 50,000
    counts, 64 blocks a language at least) is one task's matrix and gives one part a pair of sources,
    so the largest intermediate is blocks times the pairs of the result.
    """
    counts = materialise(count_terms(docs, text_col, lang_col, source_col), "term-counts")
    words = counts.where("term <> ''")
    kept = materialise(words.groupBy("lang", "term").agg(F.sum("docs").alias("_docs")).where(F.col("_docs") >= min_docs).select("lang", "term"), "kept-terms")
    entries = materialise(words.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "term-entries")
    blocks = max(LEAST_BLOCKS, -(-entries.count() // ENTRIES))
    by_source = entries.groupBy("lang", "source").agg(F.sum("n").alias("_n"))
    by_lang = entries.groupBy("lang").agg(F.sum("n").alias("_all"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("_v"))
    twice = 2 * F.coalesce(F.col("_v"), F.lit(0))
    groups = counts.where("term = ''").select("lang", "source").join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").join(sizes, "lang", "left").select(
        "lang", "source", (F.coalesce("_n", F.lit(0)) + twice).alias("total"), (F.coalesce("_all", F.lit(0)) + twice).alias("lang_total"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    placed = entries.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))

    def parts(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(block_parts(key, left, right, top)), schema=pa.schema([("lang", pa.string()), ("part", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())]))

    found = materialise(placed.groupBy("lang", "block").cogroup(groups.groupBy("lang", "block")).applyInArrow(parts, PARTS), "divergence-parts")
    pairs = found.where("part = 'pair'").groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", "part", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("_p"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.select("lang", "source", "part", "item", "value", F.row_number().over(order).cast("int").alias("rank"))
    return ranked(both.select("lang", "part", "_p.source", "_p.item", "value")).unionByName(ranked(found.where("part = 'term'")).where(F.col("rank") <= top))
