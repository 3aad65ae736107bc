"""Language identification by Bayesian evidence fusion.

Evidence of a page: its text (a naive Bayes model over hashed byte trigrams, fitted on
labelled documents), the language its markup declares, the suffix of its address and the
languages of its host. How often a declaration or suffix goes with a language, and the host
priors, are grouped sums of the text's posteriors; a host's prior is smoothed towards its
domain's, that towards all pages', and leaves the page itself out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import extras, materialise, restored
from freshet.llm.html_layout import declared_language, parse, render

BUCKETS = 1 << 14
#: A text counts as so many trigrams at most, since trigrams of one text aren't independent.
EVIDENCE = 60
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[[*range(0x09, 0x0E)]] = 0x20
#: ASCII signs and digits say nothing: they count as space.
_FOLD[[b for b in range(0x21, 0x80) if not chr(b).isalpha()]] = 0x20


def trigrams(text: bytes) -> np.ndarray:
    """Bucket of every byte trigram of a folded text."""
    x = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)].astype(np.uint32)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0x20) | (x[:-1] != 0x20)
    x = x[keep]
    if len(x) < 3:
        return np.zeros(0, np.int64)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - 14)).astype(np.int64)


def fit_text_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_languages: int = 500) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities of trigram buckets by language), from all labelled rows.

    Counts are summed per task and language before the shuffle: at most languages x BUCKETS
    rows a task, and as many come to the driver. Rows with a null text or language are left out.
    """
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                sums[lang] += np.bincount(trigrams(text.encode()), minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    table = labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).limit(max_languages * BUCKETS + 1).toArrow()
    lang = table.column("lang").combine_chunks().dictionary_encode()
    languages = sorted(lang.dictionary.to_pylist())
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    counts = np.full((len(languages), BUCKETS), 0.5)
    if languages:
        place = np.array([languages.index(x) for x in lang.dictionary.to_pylist()])
        counts[place[lang.indices.to_numpy()], table.column("bucket").to_numpy()] += table.column("n").to_numpy()
    return languages, np.log(counts / counts.sum(1, keepdims=True))


def text_posterior(text: str, model: np.ndarray) -> np.ndarray:
    """Log likelihood of a text by language, normed to a posterior under equal priors."""
    grams = trigrams(text.encode())
    if not len(grams):
        return np.full(len(model), -np.log(max(len(model), 1)))
    score = sum(model[:, part].sum(1) for part in np.array_split(grams, len(grams) // 50_000 + 1)) * (min(len(grams), EVIDENCE) / len(grams))
    score -= score.max()
    return score - np.log(np.exp(score).sum())


_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", re.I)


def address(url: str | None) -> tuple[str, str, str]:
    """(host, domain, suffix) of an address; empty where there is none."""
    m = _HOST.match(url or "")
    host = m[1].lower().strip(".") if m else ""
    parts = host.split(".")
    if not host or host.startswith("[") or parts[-1].isdigit():
        return host, host, ""
    return host, ".".join(parts[-2:]), parts[-1]


Model = tuple[list[str], np.ndarray]
OWN = ("lang", "confidence", "text_lang", "declared", "host")


def _evidence(rows: DataFrame, keep: list[str], model: Model, read_row) -> DataFrame:
    """One row per row of ``rows``: its kept columns and the evidence that ``read_row`` finds in
    its ``_url`` and ``_body``: (host, domain, suffix, declared language, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(model[1])  # at most max_languages x BUCKETS numbers
    names = ("host", "_domain", "_suffix", "declared")
    schema = T.StructType([*[f for f in rows.schema.fields if f.name in keep], *[T.StructField(c, T.StringType()) for c in names], T.StructField("_text", T.ArrayType(T.DoubleType()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, max(whole.num_rows, 1), 256):
                batch = whole.slice(at, 256)
                found = [read_row(url, body) for url, body in zip(batch.column("_url").to_pylist(), batch.column("_body").to_pylist(), strict=True)]
                columns = {c: batch.column(c) for c in keep}
                columns |= {c: pa.array([f[k] for f in found], pa.string()) for k, c in enumerate(names)}
                columns["_text"] = pa.array([text_posterior(f[4], shared.value).tolist() for f in found], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_pydict(columns)

    return materialise(rows.mapInArrow(read, schema), "evidence")


def _fuse(seen: DataFrame, keep: list[str], languages: list[str], host_weight: float, domain_weight: float, smoothing: float) -> DataFrame:
    """The posterior of every row from its text, declaration and suffix and its host's prior."""
    n = len(languages)
    soft = [F.exp(F.col("_text")[i]) for i in range(n)]

    def sums(by: str) -> DataFrame:
        name = "_n" + by.strip("_")
        rows = seen.groupBy(by).agg(*[F.sum(x).alias(f"s{i}") for i, x in enumerate(soft)])
        return materialise(rows.select(by, F.array(*[F.col(f"s{i}") for i in range(n)]).alias(name)), name)

    total = seen.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in soft]).first()
    whole = np.array([float(x) for x in total]) + smoothing
    joined = seen
    for key in ("host", "_domain", "_suffix", "declared"):
        joined = joined.join(sums(key), key, "left")
    joined = joined.withColumns({"_base": F.array(*[F.lit(float(x)) for x in whole / whole.sum()]), "_soft": F.transform("_text", lambda x: F.exp(x))})

    def smoothed(c: str, towards: Column, weight: float) -> Column:
        """Parts of the languages there, without this row, drawn ``weight`` rows' worth towards others."""
        rows = F.greatest(F.aggregate(c, F.lit(0.0), lambda a, x: a + x) - 1, F.lit(0.0))
        others = F.zip_with(c, "_soft", lambda a, own: F.greatest(a - own, F.lit(0.0)))
        return F.zip_with(others, towards, lambda o, t: (o + weight * t) / (rows + weight))

    def ratio(c: str) -> Column:
        """P(language | evidence) over P(language), which is P(evidence | language) up to a constant, as logarithms."""
        return F.zip_with(smoothed(c, F.col("_base"), smoothing), "_base", lambda p, b: F.log(p / b))

    none, add = F.transform("_base", lambda b: F.lit(0.0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    host = smoothed("_nhost", smoothed("_ndomain", F.col("_base"), domain_weight), host_weight)
    prior = F.transform(F.when(F.col("host") == "", F.col("_base")).otherwise(host), lambda x: F.log(x))
    marks = F.when(F.col("declared") == "", none).otherwise(ratio("_ndeclared"))
    tails = F.when(F.col("_suffix") == "", none).otherwise(ratio("_nsuffix"))
    names = F.array(*[F.lit(x) for x in languages])
    out = joined.withColumn("_scores", add(add(add(F.col("_text"), prior), marks), tails)).withColumn("_best", F.array_max("_scores"))
    return out.select(
        *[F.col(f"`{c}`") for c in keep],
        F.element_at(names, F.array_position("_scores", F.col("_best")).cast("int")).alias("lang"),
        (1.0 / F.aggregate("_scores", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_best")))).alias("confidence"),
        F.element_at(names, F.array_position("_text", F.array_max("_text")).cast("int")).alias("text_lang"),
        F.when(F.col("declared") != "", F.col("declared")).alias("declared"), "host",
    )


def _identify(rows: DataFrame, url_col: str | None, body_col: str, model: Model, read_row, weights: tuple[float, float, float]) -> DataFrame:
    passed = [c for c in extras(rows, [*OWN, body_col]) if c != url_col]
    back = {f"_kept{i}": c for i, c in enumerate(passed)}
    keep = list(back)
    url = F.lit(None).cast("string") if url_col is None else F.col(url_col)
    slim = rows.select(*[F.col(f"`{c}`").alias(k) for k, c in back.items()], url.alias("_url"), F.col(body_col).alias("_body"))
    if not model[0]:
        return slim.select(*[F.col(k).alias(c) for k, c in back.items()], *[F.lit(None).cast("double" if c == "confidence" else "string").alias(c) for c in OWN])
    return restored(_fuse(_evidence(slim, keep, model, read_row), keep, model[0], *weights), back)


def _read_page(url: str | None, html: str | None) -> tuple[str, str, str, str, str]:
    root = parse(html or "")
    return *address(url), declared_language(root) or "", render(root)


def _read_text(source: str | None, text: str | None) -> tuple[str, str, str, str, str]:
    return source or "", "", "", "", text or ""


def identify_pages(
    pages: DataFrame, model: Model, url_col: str = "url", html_col: str = "html",
    host_weight: float = 4.0, domain_weight: float = 8.0, smoothing: float = 1.0,
) -> DataFrame:
    """Language of every page: the columns of ``pages`` but address and markup, with
    ``lang``, ``confidence`` (its posterior), ``text_lang``, ``declared`` and ``host``.
    Columns of those names are replaced. ``model`` is :func:`fit_text_model`'s.

    Edge cases: a page without text, declaration and address gets the most frequent
    language; with a model of no languages ``lang`` is null. Of equally likely languages the first in
    alphabetical order counts. A null or malformed address is
    the host "". Rows that repeat an id are pages of their own. An empty table gives an
    empty table.

    At scale: pages are read once; what follows works on a row of a few numbers a page.
    Sums by host, domain, suffix and declaration combine map-side, so a host with a third
    of all pages is a partial sum in every task; sums are written and joined back by plain
    shuffle joins, which adaptive execution splits or broadcasts by size.
    """
    return _identify(pages, url_col, html_col, model, _read_page, (host_weight, domain_weight, smoothing))


def identify_texts(
    docs: DataFrame, model: Model, source_col: str | None = "source", text_col: str = "text",
    host_weight: float = 4.0, domain_weight: float = 8.0, smoothing: float = 1.0,
) -> DataFrame:
    """The same for plain texts: no markup, no address; a document's source stands for its
    host. A null or empty text leaves the source's prior."""
    return _identify(docs, source_col, text_col, model, _read_text, (host_weight, domain_weight, smoothing))
