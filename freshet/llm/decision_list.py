"""Quality rules as a learned decision list, in DataFrame and SQL functions only.

Base statistics of a text are Column expressions. From labelled documents, sequential
covering learns ordered rules: each rule grows a conjunction of thresholds by FOIL gain
on two thirds of the labelled rows and is pruned on the other third; rows that it covers
go, and the next rule is grown on the rest. The list becomes one CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import SPACES, WORD, extras, materialise, restored, stowed

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: What rules may test; every one is a double computed by :func:`shares`.
FEATURES = ("words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share")
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _removed(text: Column, chars: str) -> Column:
    """Number of characters of ``text`` among the ASCII characters ``chars``."""
    left = text
    for c in chars:
        left = F.replace(left, F.lit(c), F.lit(""))
    return F.octet_length(text) - F.octet_length(left)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with, as long: n_words; word_chars (code points in words);
    n_symbols (of ``#*$%&|<>``); n_dup_lines (lines with a word, equal to an earlier line);
    n_repeat_words (words in 8-word windows that the text holds twice or more, the first
    included); n_lines (with a word) and n_distinct (different words).

    A null text counts as empty, where all are 0. Columns of those names are replaced.
    Everything is a projection: no shuffle, nothing leaves the JVM.
    """
    own = [*STATISTICS, "n_lines", "n_distinct"]
    back = {f"_kept{i}": c for i, c in enumerate(extras(docs, own))}
    kept = [*back]
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    step = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in back.items()], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    step = step.select(*kept, "_t", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)).alias("_words"), lines.alias("_lines"))
    step = step.select(
        *kept, F.size("_words").cast("long").alias("n_words"),
        (F.length("_t") - _removed(F.col("_t"), SPACES)).cast("long").alias("word_chars"),
        _removed(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    # Each array is referred to more than once below, so that Spark computes it once.
    step = step.withColumn("n_distinct", F.size(F.array_distinct("_hashes")).cast("long")).withColumn(
        "_windows",
        F.when(F.size("_hashes") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_hashes") - WINDOW), lambda i: F.xxhash64(F.slice("_hashes", i + 1, F.lit(WINDOW))))),
    )
    step = step.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )

    def again(x: Column, k: Column) -> Column:
        """Equal to the window before or after it in sorted order."""
        n = F.size("_sorted")
        return ((k > 0) & (F.try_element_at("_sorted", F.greatest(k, F.lit(1)))["h"] == x["h"])) | (
            (k < n - 1) & (F.try_element_at("_sorted", F.least(k + 2, n))["h"] == x["h"])
        )

    step = step.withColumn("_at", F.sort_array(F.transform(F.filter("_sorted", again), lambda x: x["i"])))
    covered = F.aggregate(
        F.zip_with("_at", F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0), lambda a, x: a + x,
    )
    step = step.withColumn("n_repeat_words", F.coalesce(F.when(F.size("_at") > 0, covered), F.lit(0)).cast("long"))
    return step.select(*[F.col(k).alias(c) for k, c in back.items()], *own)


def base_failed() -> Column:
    """Too short, or mostly repeated: over the columns of :func:`statistics`."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def shares() -> dict[str, Column]:
    """The rule features over the columns of :func:`statistics`; 0 where the divisor is 0."""

    def ratio(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    columns = (
        F.col("n_words").cast("double"), ratio("word_chars", "n_words"), ratio("n_symbols", "word_chars"),
        ratio("n_dup_lines", "n_lines"), ratio("n_repeat_words", "n_words"), ratio("n_distinct", "n_words"),
    )
    return dict(zip(FEATURES, columns, strict=True))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = shares()[self.feature]
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects, a document that none covers is kept."""

    rules: list[Rule] = field(default_factory=list)

    def verdict(self) -> Column:
        """Number of the rule that rejects (from 1), or 0: an ordered conditional expression."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            out = F.when(rule.column(), F.lit(k)) if out is None else out.when(rule.column(), F.lit(k))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))

    def keeps(self) -> Column:
        return self.verdict() == 0

    def __str__(self) -> str:
        return "\n".join(f"{k}. reject if " + " and ".join(map(str, r.conditions)) + f"  (held-out precision {r.precision:.3f} of {r.covered})" for k, r in enumerate(self.rules, 1))


def learn_rules(
    stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
    cuts: int = 40, max_rules: int = 6, max_conditions: int = 3, min_precision: float = 0.9, min_covered: int = 5,
) -> DecisionList:
    """Learn which documents to reject from ``labels`` (id, 0 = reject, 1 = keep).

    ``stats`` has the columns of :func:`statistics`. Features are cut at up to ``cuts``
    quantiles of the labelled rows. A rule stays if, on the third held out, its precision
    is at least ``min_precision`` and it covers ``min_covered`` rows at least; the first
    that does not ends the list. Null labels are ignored, ids without statistics too.
    Without rows of both labels the list is empty and keeps everything.

    At scale: one aggregation per condition, over bins summed map-side; what comes to the
    driver is a count per feature, bin, label and part, whatever the number of rows.
    """
    columns = shares()
    labelled = materialise(
        labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_lid"), (F.col(label_col) == 0).alias("bad"))
        .join(stats, F.col("_lid") == F.col(id_col))
        .select("bad", (F.pmod(F.xxhash64("_lid"), F.lit(3)) < 2).alias("grow"), *[c.alias(n) for n, c in columns.items()]),
        "labelled",
    )
    at = labelled.agg(*[F.percentile_approx(n, [k / cuts for k in range(cuts + 1)], 10_000).alias(n) for n in FEATURES]).first()
    edges = {n: sorted(set(at[n] or [])) for n in FEATURES}
    if not any(edges.values()):
        return DecisionList()

    def bin_of(n: str) -> Column:
        """Number of cuts below x, so that x <= edges[k] where its bin is <= k."""
        return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges[n]]), lambda e: e < F.col(n)))

    bins = materialise(labelled.select("bad", "grow", *[bin_of(n).alias(n) for n in FEATURES]), "bins")

    def holds(conditions: list[tuple[str, bool, int]]) -> Column:
        out = F.lit(True)
        for n, above, k in conditions:
            out = out & ((F.col(n) > k) if above else (F.col(n) <= k))
        return out

    def counts(rows: DataFrame) -> dict[tuple[str, bool, bool], dict[int, int]]:
        long = rows.select("bad", "grow", F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("b")) for n in FEATURES])).alias("x"))
        found: dict = {}
        for r in long.groupBy("x.f", "x.b", "bad", "grow").agg(F.count("*").alias("n")).collect():
            found.setdefault((r["f"], r["bad"], r["grow"]), {})[r["b"]] = r["n"]
        return found

    def total(found, bad: bool, grow: bool) -> int:
        return sum(found.get((FEATURES[0], bad, grow), {}).values())

    def options(found, grow: bool):
        """(condition, rejected, kept) for every threshold."""
        for n in FEATURES:
            p, q = found.get((n, True, grow), {}), found.get((n, False, grow), {})
            for k in range(len(edges[n]) - 1):
                below = (sum(v for b, v in p.items() if b <= k), sum(v for b, v in q.items() if b <= k))
                yield (n, False, k), *below
                yield (n, True, k), sum(p.values()) - below[0], sum(q.values()) - below[1]

    rules, left = [], F.lit(True)
    for _ in range(max_rules):
        chosen: list[tuple[str, bool, int]] = []
        held: list[tuple[int, int]] = []
        while True:
            found = counts(bins.where(left & holds(chosen)))
            held.append((total(found, True, False), total(found, False, False)))
            p0, q0 = total(found, True, True), total(found, False, True)
            if not p0 or not q0 or len(chosen) == max_conditions:
                break
            best = max(((p * (math.log2(p / (p + q)) - math.log2(p0 / (p0 + q0))), p, c) for c, p, q in options(found, True) if p), default=(0, 0, None))
            if best[0] <= 0:
                break
            chosen.append(best[2])
        # prune: the prefix that does best on the rows held out
        worth = [((p - q) / (p + q) if p + q else -1.0, -k) for k, (p, q) in enumerate(held) if k]
        if not worth:
            break
        size = -max(worth)[1]
        p, q = held[size]
        if p + q < min_covered or p < min_precision * (p + q):
            break
        chosen = chosen[:size]
        rules.append(Rule(tuple(Condition(n, above, float(edges[n][k])) for n, above, k in chosen), p / (p + q), p + q))
        left = left & ~holds(chosen)
    return DecisionList(rules)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Statistics and verdict of every document: its columns without the text, the columns
    of :func:`statistics`, base_failed, rule (0 or the rejecting rule's number) and kept.

    Every row is judged by its own text; a null id only keeps a row from being labelled. An
    empty table gives an empty table.
    """
    docs, back = stowed(docs, [id_col, text_col], [*STATISTICS, "n_lines", "n_distinct", "base_failed", "rule", "kept"])
    stats = materialise(statistics(docs, text_col).drop(text_col), "statistics")
    rules = learn_rules(stats, labels, id_col, **options)
    return restored(
        stats.withColumn("base_failed", base_failed()).withColumn("rule", rules.verdict())
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), back
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that neither the base rules nor the learned list reject, with
    the columns of ``docs``. The rows are written once with their statistics, to learn
    from and to filter: nothing is shuffled, and a row is judged by its own text even if
    its id is null or repeated."""
    names, own = docs.columns, [*STATISTICS, "n_lines", "n_distinct"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    judged = materialise(statistics(packed, "_text").drop("_text"), "judged")
    rules = learn_rules(judged.select(F.col("_row")[id_col].alias(id_col), *own), labels, id_col, **options)
    return judged.where(~base_failed() & rules.keeps()).select(*[F.col("_row")[c].alias(c) for c in names])
