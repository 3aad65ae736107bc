"""Best-fit packing by vector best fit.

A bin has three capacities: tokens, documents and attention cost (the sum of squared
lengths). All three demands of a piece follow from its length, so packing works on the
histogram of lengths, which has at most ``max_tokens`` rows however large the corpus:
one bin shape is built at a time by the vector rule, used as often as its lengths last,
and Spark then deals every piece to its place by its rank within its length.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import extras, materialise

_ENCODERS: dict[str, tuple] = {}
#: Bytes, about, in which a Python worker remembers the ids of words (beyond it the memory starts
#: anew), and characters of the longest word that it remembers.
REMEMBERED_BYTES, REMEMBERED_CHARS = 96 << 20, 48
#: Texts that are encoded at a time: number and characters.
BATCH_TEXTS, BATCH_CHARS = 512, 4_000_000
# How a tokenizer file says that white space only parts words and that case is
# dropped, with letters, digits and other signs apart and bytes written as letters.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
#: Pieces of one length that one task ranks, about.
PER_SALT = 50_000


def _encoder(path: str) -> tuple:
    """The tokenizer, the ids of the words it remembers and their bytes in memory, about."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _ENCODERS[path] = (Tokenizer.from_file(path), {}, [0])
    return _ENCODERS[path]


def goes_by_word(path: str) -> bool:
    """Whether a tokenizer file has the form for which the ids of a text are known to be
    those of its words in a row, as :func:`_words` and :func:`_learn` compute them."""
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    model = parts.get("model") or {}
    plain = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    marked = all(
        t["content"].startswith("<|") and not re.search(r"\s", t["content"]) and not any(t.get(x) for x in ("single_word", "lstrip", "rstrip", "normalized")) for t in parts.get("added_tokens") or []
    )
    return (
        model.get("type") == "BPE" and plain and marked and parts.get("normalizer") == _NORMALIZER and parts.get("pre_tokenizer") == _SPLITTER
        and not any(parts.get(x) for x in ("truncation", "padding", "post_processor"))
    )


def _words(text: str) -> list[str]:
    """The space-separated words of a text in the form that is looked up.

    Holds for tokenizers that drop white space between words and lower-case: there,
    the ids of a text are the ids of its words in a row. Lower case is taken ahead
    only for Latin-1 without a special token, where it is one character for another.
    """
    if "<|" not in text:
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
    return text.replace("\n", " ").split(" ")


#: Letters, then perhaps signs that are neither letters, digits, white space nor an apostrophe.
_PLAIN = re.compile(r"([^\W\d_]+)([^\w\s']*)")


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write the bytes that don't print: as letters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}


_BYTES = _byte_letters()


def _learn(words: set[str], known: dict[str, bytes], tokenizer) -> None:
    """Add the ids of words. Plain lower-case words go to the vocabulary's merges
    directly, as the letters and the signs after them; any other through the whole tokenizer."""
    merge, rest = tokenizer.model.tokenize, []

    def ids(part: str) -> bytes:
        return array("I", [t.id for t in merge(part.encode().decode("latin-1").translate(_BYTES))]).tobytes()

    for word in words:
        m = _PLAIN.fullmatch(word)
        if m and m[1].isalpha() and word == word.lower() and max(word) < "\u0100":
            letters, signs = m.groups()
            if letters not in known:
                known[letters] = ids(letters)
            if signs:
                if signs not in known:
                    known[signs] = ids(signs)
                known[word] = known[letters] + known[signs]
        else:
            rest.append(word)
    for at in range(0, len(rest), 20_000):
        part = rest[at : at + 20_000]
        for word, e in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
            known[word] = array("I", e.ids).tobytes()


def encode_texts(texts: Sequence[str], path: str, by_word: bool = False) -> list[bytes]:
    """Token ids of each text as little-endian unsigned 32-bit integers; word by word only
    for a tokenizer that :func:`goes_by_word`."""
    tokenizer, known, held = _encoder(path)
    if not by_word:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(list(texts), add_special_tokens=False)]
    if held[0] > REMEMBERED_BYTES:
        known.clear()
        held[0] = 0
    split = [_words(t) for t in texts]
    new = set().union(*split).difference(known)
    before = len(known)
    if new:
        _learn(new, known, tokenizer)
    find = known.__getitem__
    out = [b"".join(map(find, words)) for words in split]
    for word in list(islice(known, before, None)):
        if len(word) > REMEMBERED_CHARS:
            del known[word]
        else:
            held[0] += 200 + 4 * len(word)
    return out


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts to encode at a time, one text at least."""
    start, chars = 0, 0
    for k, text in enumerate(texts):
        if k > start and (k - start >= BATCH_TEXTS or chars + len(text) > BATCH_CHARS):
            yield start, k
            start, chars = k, 0
        chars += len(text)
    yield start, len(texts)


def tokenize_pieces(
    docs: DataFrame, tokenizer_path: str, max_tokens: int = 4096, end_id: int | None = 1,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Token pieces of every document: id, piece, start, length and ``ids`` (binary,
    little-endian unsigned 32-bit). ``end_id`` ends each document. Only a document of
    more than ``max_tokens`` ids is cut, at every multiple of ``max_tokens``.

    A null or empty text has ``end_id`` alone. Rows that repeat an id are pieces of
    their own. An empty table gives an empty table. ``tokenizer_path`` must be readable on
    the driver and on every executor.
    """
    by_word = goes_by_word(tokenizer_path)
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            every = [t or "" for t in whole.column("text").to_pylist()]
            for a, z in _batches(every):
                batch, texts = whole.slice(a, z - a), every[a:z]
                doc, piece, start, length, ids = [], [], [], [], []
                for d, e in zip(batch.column("doc_id").to_pylist(), encode_texts(texts, tokenizer_path, by_word), strict=True):
                    e += end
                    for k, b in enumerate(range(0, max(len(e), 1), 4 * max_tokens)):
                        part = e[b : b + 4 * max_tokens]
                        doc.append(d), piece.append(k), start.append(b // 4), length.append(len(part) // 4), ids.append(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, batch.schema.field("doc_id").type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    return slim.mapInArrow(encode, schema)


@dataclass(frozen=True)
class Capacities:
    """Limits of one bin. Without a limit on documents or attention cost, those of a
    bin filled with single tokens hold, which never bind."""

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None
    rule: str = "dot"  # or "norm"
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25)

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], float)


def bin_shapes(counts: dict[int, int], caps: Capacities) -> list[tuple[int, list[tuple[int, int]]]]:
    """Shapes of bins and how often each is used: [(times, [(length, copies)])].

    A shape starts with the longest length left and takes, again and again, the length
    that fits every residual capacity and has the largest weighted dot product of demand
    and residual (rule "dot"), or leaves the residual of the least weighted norm (rule
    "norm"); ties go to the longer. The demands are normed by the capacities.
    """
    cap, w = caps.vector(), np.array(caps.weights)
    lengths = np.array(sorted((n for n, c in counts.items() if c and n > 0), reverse=True), dtype=np.int64)
    left = np.array([counts[int(n)] for n in lengths], dtype=np.int64)
    demand = np.stack([lengths, np.ones_like(lengths), lengths**2], 1) if len(lengths) else np.zeros((0, 3))
    unit = demand / cap
    if len(lengths) and (demand[0] > cap).any():
        raise ValueError(f"a piece of {lengths[0]} tokens does not fit an empty bin")
    shapes = []
    while left.any():
        head = int(np.argmax(left > 0))
        free, used = cap - demand[head], {head: 1}
        while True:
            rest = left.copy()
            for i, n in used.items():
                rest[i] -= n
            fits = (rest > 0) & (demand <= free).all(1)
            if not fits.any():
                break
            at = np.flatnonzero(fits)
            room = free / cap
            score = unit[at] @ (w * room) if caps.rule == "dot" else -(((room - unit[at]) ** 2) @ w)
            k = int(at[np.argmax(score)])
            used[k] = used.get(k, 0) + 1
            free = free - demand[k]
        times = min(int(left[i] // n) for i, n in used.items())
        for i, n in used.items():
            left[i] -= n * times
        shapes.append((times, [(int(lengths[i]), n) for i, n in used.items()]))
    return shapes


def pack_pieces(pieces: DataFrame, length_col: str = "length", order_cols: Sequence[str] = ("doc_id", "piece"), caps: Capacities | None = None) -> DataFrame:
    """Give every piece a bin: the columns of ``pieces`` with ``sequence_id`` and
    ``offset`` (long), which replace columns of those names.

    Every bin keeps within ``caps``; offsets in a bin run gapless from 0. Pieces of
    length 0 or null get null places. Pieces that are equal in ``order_cols`` and length
    may change places with each other, nothing else depends on the partitioning. An
    empty table gives an empty table.

    At scale: the driver gets a count per length (at most ``tokens``) and per salt of a
    length, one salt for about ``PER_SALT`` pieces. Ranks are counted within (length, salt),
    so a length that a third of all pieces share is spread over as many tasks as its share
    needs. The places of each length (a row a length) are broadcast.
    """
    caps = caps or Capacities()
    spark = pieces.sparkSession
    keep = extras(pieces, ["sequence_id", "offset"])
    base = pieces.select(*[F.col(f"`{c}`") for c in keep]).withColumn("_n", F.col(length_col).cast("long"))
    counts = {r["_n"]: r["c"] for r in base.where(F.col("_n") > 0).groupBy("_n").agg(F.count("*").alias("c")).collect()}
    salts = {n: -(-c // PER_SALT) for n, c in counts.items()}
    widths = F.broadcast(spark.createDataFrame(list(salts.items()), "_n long, _w long"))
    base = base.join(widths, "_n", "left").withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in order_cols]), F.coalesce("_w", F.lit(1))).cast("int")).drop("_w")
    first: dict[tuple[int, int], int] = {}
    ranks = dict.fromkeys(counts, 0)
    for r in sorted(base.where(F.col("_n") > 0).groupBy("_n", "_salt").agg(F.count("*").alias("c")).collect()):
        first[r["_n"], r["_salt"]] = ranks[r["_n"]]
        ranks[r["_n"]] += r["c"]
    places: dict[int, list[tuple]] = {n: [] for n in counts}
    taken = dict.fromkeys(counts, 0)
    sequence = 0
    for times, shape in bin_shapes(counts, caps):
        offset = 0
        for n, copies in shape:
            places[n].append((taken[n], copies, sequence, offset))
            taken[n] += copies * times
            offset += copies * n
        sequence += times
    # One row a length (at most the capacity in tokens): the first rank of each salt, and
    # the few shapes that the length is part of.
    slots = spark.createDataFrame(
        [(n, [first.get((n, s), 0) for s in range(salts[n])], [list(p) for p in places[n]]) for n in counts], "_n long, _first array<long>, _places array<array<long>>"
    )
    ranked = base.withColumn("_r", F.row_number().over(Window.partitionBy("_n", "_salt").orderBy(*order_cols)))
    placed = (
        ranked.join(F.broadcast(slots), "_n", "left")
        .withColumn("_rank", F.col("_first")[F.col("_salt")] + F.col("_r") - 1)
        # the last shape whose first rank is not beyond this piece's
        .withColumn("_p", F.expr("element_at(filter(_places, p -> p[0] <= _rank), -1)"))
        .withColumn("_k", F.col("_rank") - F.col("_p")[0])
    )
    return placed.select(
        *[F.col(f"`{c}`") for c in keep],
        (F.col("_p")[2] + F.expr("_k div _p[1]")).alias("sequence_id"),
        (F.col("_p")[3] + F.expr("(_k % _p[1])") * F.col("_n")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, caps: Capacities | None = None, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    An empty table gives an empty table; a null text is the end token alone.

    The ids are digested before anything is shuffled; the small table of pieces is
    written once to the shared scratch folder, so texts are encoded once.
    """
    caps = caps or Capacities()
    pieces = tokenize_pieces(docs, tokenizer_path, caps.tokens, end_id, id_col, text_col).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    return pack_pieces(materialise(pieces, "pieces"), caps=caps)
