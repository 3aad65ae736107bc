"""URL filters by association rules.

Declared rules (a host with its subdomains, and a path prefix) judge what they fit. The
addresses that they judge are the labelled ones: Spark's FP-growth mines their token
combinations together with the verdict, rules are pruned by support, confidence and by more general
rules that say the same, and what no declared rule fits is judged by the mined ones. An
inverted index posts a rule under its rarest token, so that an address meets only rules of which it holds that one.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import ascii_lower, materialise

#: (verdict, host, path): the rules of the registered query.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
VERDICTS = ("allow", "block")
#: Rules, and characters of their tokens, that are sent to every task; with more, addresses and index are joined.
SENT_RULES, SENT_CHARS = 50_000, 8_000_000


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def declared_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null where none does. Of equally long
    rules the first in order of host and path, then of the list, holds."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]), reverse=True):
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(prefix))
        out = F.when(fits, F.struct(F.lit(at + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """The distinct tokens of an address: scheme, labels of the host, words of the path, terms of the query, fragment.

    Each has a mark for its part in front; runs of digits are one sign, so that pages of one form
    share their tokens. All of the address is read.
    """
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(?s)#(.*)", 1)

    def marked(mark: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), F.regexp_replace(ascii_lower(x), r"[0-9]+", "0")))

    return F.array_distinct(F.concat(
        marked("scheme ", F.array(scheme)), marked("host ", F.split(host_of(url), r"\.")), marked("path ", F.split(path_of(url), r"[/._-]")),
        marked("query ", F.split(query, "[&;]")), marked("fragment ", F.array(fragment)),
    ))


@dataclass
class Mined:
    """Rules (tokens, verdict, support, confidence, rarest), and of every token in enough labelled rows the one that stands for it."""

    rules: DataFrame
    stands_for: dict[str, str]


def _frequent(rows: DataFrame, least: int) -> DataFrame:
    """(token, first, n) of the tokens in ``least`` rows or more: ``first`` is the first of the tokens that
    are in the very same rows.

    Those are told by their number of rows and, over the distinct (tokens, verdict) that hold them, their number
    and two 64-bit sums of hashes. Without them a family of addresses with fifty constant tokens
    would have 2^50 frequent sets.
    """
    kinds = rows.groupBy("tokens", "verdict").agg(F.count("*").alias("_n"))
    held = kinds.select(F.explode("tokens").alias("token"), "_n", F.xxhash64("tokens", "verdict").alias("_x"), F.xxhash64(F.lit(1), "tokens", "verdict").alias("_y"))
    signed = held.groupBy("token").agg(F.sum("_n").alias("n"), F.count("*").alias("_k"), F.bit_xor("_x").alias("_x"), F.bit_xor("_y").alias("_y")).where(F.col("n") >= least)
    return materialise(signed.withColumn("first", F.min("token").over(Window.partitionBy("n", "_k", "_x", "_y"))).select("token", "first", "n"), "frequent-tokens")


def known_tokens(tokens: Column, stands_for: dict[str, str]) -> Column:
    """The frequent tokens among these, each by the one that stands for it."""
    other = {t: f for t, f in stands_for.items() if t != f}
    kept = F.filter(tokens, lambda t: t.isin(sorted(stands_for)))
    if other:
        names = F.map_from_arrays(F.array(*map(F.lit, other)), F.array(*map(F.lit, other.values())))
        kept = F.array_distinct(F.transform(kept, lambda t: F.coalesce(F.element_at(names, t), t)))
    return kept


def mine_rules(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8, min_rows: int = 10, url_col: str = "url", verdict_col: str = "verdict") -> Mined:
    """What token combinations of labelled addresses say.

    A combination counts where it is in ``min_support`` of the labelled rows, and ``min_rows`` of them, with one verdict, and is a
    rule where that verdict has ``min_confidence`` of the rows that hold it. A rule goes where
    a part of its tokens is a rule for the same verdict with no less confidence. ``rarest`` is
    the token of the rule in the fewest labelled rows. Every labelled row counts, repeated ones too. Tokens that
    are in the very same labelled rows are one token: an address holds it that holds any of them.
    """
    spark = labelled.sparkSession
    rows = materialise(labelled.select(tokens_of(F.col(f"`{url_col}`")).alias("tokens"), F.col(f"`{verdict_col}`").alias("verdict")), "labelled-urls")
    n = rows.count()
    least = max(math.ceil(min_support * n), min_rows)
    frequent = _frequent(rows, least)
    stands_for = {r["token"]: r["first"] for r in frequent.toLocalIterator()}  # at most (tokens of an address) / min_support
    if not stands_for:
        return Mined(spark.createDataFrame([], "tokens array<string>, verdict string, support double, confidence double, rarest string"), {})
    items = rows.select(F.concat(known_tokens(F.col("tokens"), stands_for), F.array(F.concat(F.lit("verdict "), "verdict"))).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=min_confidence).fit(items)
    sets = materialise(found.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "frequent-sets")
    named = lambda x: F.startswith(x, F.lit("verdict "))
    sure = sets.where(F.exists("items", named) & (F.size("items") > 1)).select(
        F.filter("items", lambda x: ~named(x)).alias("tokens"), F.substring(F.filter("items", named)[0], 9, 1 << 30).alias("verdict"), F.col("freq").alias("_hits")
    )
    alone = sets.where(~F.exists("items", named)).select(F.col("items").alias("tokens"), F.col("freq").alias("_all"))
    rules = sure.join(alone, "tokens").withColumn("confidence", F.col("_hits") / F.col("_all")).where(F.col("confidence") >= min_confidence)
    rare = rules.select("tokens", "verdict", F.explode("tokens").alias("token")).join(frequent.select("token", "n"), "token").groupBy("tokens", "verdict").agg(F.min_by("token", F.struct("n", "token")).alias("rarest"))
    rules = materialise(rules.join(rare, ["tokens", "verdict"]).select("tokens", "verdict", (F.col("_hits") / F.lit(n)).alias("support"), "confidence", "rarest"), "url-rules")
    posted = rules.select(F.col("tokens").alias("_part"), F.col("verdict").alias("_v"), F.col("confidence").alias("_c"), F.col("rarest").alias("token"))
    said = rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("token")).join(posted, "token").where(
        (F.col("verdict") == F.col("_v")) & (F.col("_c") >= F.col("confidence")) & (F.size("_part") < F.size("tokens")) & (F.size(F.array_except("_part", "tokens")) == 0)
    )
    return Mined(materialise(rules.join(said.select("tokens", "verdict").distinct(), ["tokens", "verdict"], "left_anti"), "pruned-url-rules"), stands_for)


#: What decides between rules that fit: confidence, support, the number of tokens, then the verdict and tokens themselves.
def _strength(r) -> tuple:
    return (-r["confidence"], -r["support"], -len(r["tokens"]), r["verdict"], tuple(r["tokens"]))


def index_rules(rules: list) -> dict[str, list[tuple[frozenset[str], str]]]:
    """By rarest token: (tokens, verdict) of the rules, the strongest first, each with its place among all."""
    index: dict[str, list] = defaultdict(list)
    for place, r in enumerate(sorted(rules, key=_strength)):
        index[r["rarest"]].append((place, frozenset(r["tokens"]), r["verdict"]))
    return dict(index)


def best_rule(index: dict, tokens: Sequence[str]) -> str | None:
    """Verdict of the strongest rule whose tokens are all among these."""
    held, best = set(tokens), (None, None)
    for t in held:
        for place, needed, verdict in index.get(t, ()):
            if best[0] is not None and place >= best[0]:
                break
            if needed <= held:
                best = (place, verdict)
                break
    return best[1]


def match_in_tasks(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` with ``mined``, the verdict of the strongest mined rule on ``tokens`` (null: none): the index goes to every task."""
    shared = rows.sparkSession.sparkContext.broadcast(index_rules(rules.collect()))
    schema = T.StructType([*rows.schema.fields, T.StructField("mined", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best_rule(shared.value, t) if t else None for t in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def match_by_join(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The same with index and addresses joined by token, for an index that no task should hold."""
    posted = rules.select("verdict", "confidence", "support", F.col("tokens").alias("_needed"), F.col("rarest").alias("_token"))
    sets = rows.select("tokens").where("tokens IS NOT NULL").distinct()
    met = sets.withColumn("_token", F.explode("tokens")).join(posted, "_token").where(F.size(F.array_except("_needed", "tokens")) == 0)
    best = met.groupBy("tokens").agg(F.min_by("verdict", F.struct(-F.col("confidence"), -F.col("support"), -F.size("_needed"), "verdict", "_needed")).alias("mined"))
    return rows.join(best, "tokens", "left")


OWN = ("host", "path", "rule", "verdict")


def judge_urls(
    pages: DataFrame, declared: Sequence[tuple[str, str, str]], url_col: str = "url", default: str = "allow", min_support: float = 0.01,
    min_confidence: float = 0.8, min_rows: int = 10, match: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The columns of ``pages`` but the address, with host, path, rule (the longest declared one that fits,
    else null) and verdict: that rule's, else that of the strongest mined rule whose tokens the
    address holds, else ``default``.

    Edge cases: an address that is null or has no ``://`` has an empty host and path; null has no
    tokens and gets the default. Where the declared rules fit nothing, or no combination is frequent and
    sure enough, all that they don't judge gets the default. Rows of a null or repeated id, and
    repeated addresses, are rows of their own. Columns of the names above are replaced, others pass
    whatever their names. An empty table gives an empty table.

    At scale: judging is a narrow pass over the addresses, and other columns never move. Rules are at most a few
    thousand, as each has ``min_support`` of the labelled rows and no part that says the same; their number and
    size are looked at, and beyond ``SENT_RULES`` the index is joined instead of sent. Mining counts every labelled row.
    """
    if bad := [r for r in declared if r[0] not in VERDICTS]:
        raise ValueError(f"verdicts are {VERDICTS}, not those of {bad}")
    keep = [c for c in pages.columns if c != url_col and c.lower() not in OWN]
    url = F.col(f"`{url_col}`")
    rest = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(0)
    rows = pages.select(rest.alias("rest"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("found", declared_rule(F.col("host"), F.col("path"), declared))
    mined = mine_rules(rows.where("found IS NOT NULL").select("url", "found.verdict"), min_support, min_confidence, min_rows)
    if match is None:
        size = mined.rules.agg(F.count("*"), F.coalesce(F.sum(F.length(F.array_join("tokens", " "))), F.lit(0))).first()
        match = match_in_tasks if size[0] <= SENT_RULES and size[1] <= SENT_CHARS else match_by_join
    open_rows = rows.select("rest", "host", "path", "found", F.when(F.col("found").isNull(), known_tokens(tokens_of(F.col("url")), mined.stands_for)).alias("tokens"))
    out = match(open_rows, mined.rules)
    return out.select(*[F.col("rest")[c].alias(c) for c in keep], "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", "mined", F.lit(default)).alias("verdict"))
