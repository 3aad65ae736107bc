"""Other columns pass every operator whatever their names: those that operators use inside as well."""

import re

import pytest
from pyspark.sql import functions as F

from freshet.llm import ball_tree, chosen_path, components, decision_list, html_layout, language_id, line_dedup, mixing, substring_dedup, wordhash
from tests.llm.helpers import corpus

#: Every quoted name in the operators' sources that could be one of a column.
INSIDE = sorted({
    n.lower() for module in (ball_tree, chosen_path, components, decision_list, html_layout, language_id, line_dedup, mixing, substring_dedup, wordhash)
    for n in re.findall(r'"(_?[A-Za-z][A-Za-z0-9_]{0,20})"', open(module.__file__).read())
} | {f"_kept{k}" for k in range(9)})
OPERATORS = {
    "find_factors": (lambda d, _: substring_dedup.find_factors(d, min_words=5), ["n_words", "n_removed", "factors", "spans", "kept_text"]),
    "drop_repeated_lines": (lambda d, _: line_dedup.drop_repeated_lines(d), ["n_lines", "n_dropped"]),
    "near_duplicates": (lambda d, _: chosen_path.near_duplicates(d, shingle=2), ["n_shingles", "component_id", "kept"]),
    "mix_sources": (lambda d, _: mixing.mix_sources(d, F.array("source")), ["size", "source_size", "target", "epochs", "taken"]),
    "statistics": (lambda d, _: decision_list.statistics(d), [*decision_list.STATISTICS, "n_lines", "n_distinct"]),
    "judge": (lambda d, labels: decision_list.judge(d, labels), [*decision_list.STATISTICS, "n_lines", "n_distinct", "base_failed", "rule", "kept"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_internal_names_pass(spark, name):
    run, own = OPERATORS[name]
    rows = [(r[0], r[1], r[3]) for r in corpus(n=24)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = plain.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    others = [c for c in INSIDE if c not in ("doc_id", "text", "source", *own)]
    wide = plain.select("*", *[F.concat_ws("-", F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in others])
    key = lambda rs: sorted((tuple(str(r[c]) for c in ("doc_id", *own)) for r in rs), key=str)
    got = run(wide, labels)
    assert set(others) <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    found = got.collect()
    assert key(found) == key(run(plain, labels).collect())
    for r in found:
        assert all(r[c] == f"{c}-{r['doc_id']}" for c in others)


@pytest.mark.parametrize("entries", [[1e30, 1e-3], [1e12, 1e12]])
def test_scores_beyond_a_long_are_an_error(spark, entries):
    rows = [(k, [entries[k % 2], entries[0]]) for k in range(21)]
    vectors = ball_tree.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="beyond a long|too large"):
        ball_tree.top_k(vectors, F.col("id") == 0, k=3).collect()
