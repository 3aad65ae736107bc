import random

import pytest
from pyspark.sql import functions as F

from freshet.llm import chosen_path
from freshet.llm.chosen_path import near_duplicates
from freshet.llm.decision_list import STATISTICS, DecisionList, base_failed, judge, keep_good, learn_rules, statistics
from freshet.llm.line_dedup import drop_repeated_lines
from freshet.llm.substring_dedup import find_factors
from tests.llm import helpers as h

SCHEMA = h.SCHEMA


@pytest.fixture(scope="module")
def rows():
    return h.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def clash(df):
    """Extra columns named like the operators' own and their internal ones."""
    for c in ("n_lines", "n_dropped", "n_words", "n_removed", "spans", "factors", "kept_text", "n_shingles", "component_id", "kept", "size", "target", "taken", "epochs", "grp", "block", "id", "a", "b"):
        df = df.withColumn(c, F.lit("x"))
    return df


def test_substrings_equal_brute_force(docs, rows):
    want = h.brute_substrings(rows)
    got = {r["doc_id"]: r for r in find_factors(docs).collect()}
    assert {d: (r["n_words"], r["n_removed"], r["kept_text"]) for d, r in got.items()} == want
    for r in got.values():
        assert sum(s["length"] for s in r["spans"]) == r["n_removed"]
        assert all(s["length"] >= 20 for s in r["spans"])


def check_factors(rows, got, n):
    """Factors and literals rebuild every document; sources are equal and earlier; a factor
    that continues no other has a window's length; factors are maximal for their sources' places."""
    texts = {d: h.words(t) for d, t, *_ in rows}
    seen = 0
    for r in got:
        w, at, built = texts[r["doc_id"]], 0, []
        for f in r["factors"]:
            assert f["start"] >= at and f["length"] > 0 and (f["length"] >= n or f["start"] == at > 0)
            assert (f["ref_id"], f["ref_start"]) < (r["doc_id"], f["start"])
            built += w[at : f["start"]] + texts[f["ref_id"]][f["ref_start"] : f["ref_start"] + f["length"]]
            at = f["start"] + f["length"]
            seen += 1
        assert built + w[at:] == w
        covered = {i for f in r["factors"] for i in range(f["start"], f["start"] + f["length"])}
        assert covered == {i for s in r["spans"] for i in range(s["start"], s["start"] + s["length"])} and len(covered) == r["n_removed"]
    return seen


def test_factors_rebuild_every_document(docs, rows):
    assert check_factors(rows, find_factors(docs).collect(), 20) > 30


def test_a_passage_is_one_factor_with_its_place(spark):
    """A passage copied from the middle of one text into another: one factor, to the word."""
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(5000)]
    one, two = [rng.choice(vocab) for _ in range(300)], [rng.choice(vocab) for _ in range(200)]
    cases = [(20, 1), (21, 5), (33, 60), (57, 100), (120, 150)]
    rows = [(0, " ".join(one), None, None, 0)]
    for k, (n, at) in enumerate(cases, 1):
        rows.append((k, " ".join([*two[: at + k], f"x{k}", *one[at : at + n], f"y{k}", *[rng.choice(vocab) for _ in range(30)]]), None, None, 0))
    got = {r["doc_id"]: r["factors"] for r in find_factors(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    for k, (n, at) in enumerate(cases, 1):
        assert [tuple(f) for f in got[k] if f["ref_id"] == 0] == [(at + k + 1, n, 0, at)]


@pytest.mark.parametrize("seed", [3, 4])
def test_substrings_on_few_words(spark, seed):
    """A tiny vocabulary: windows, anchors and blocks repeat in every way."""
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))), None, None, 0) for i in range(40)]
    rows += [(100 + i, " ".join(["a b"] * i), None, None, 0) for i in range(9, 25)]
    got = find_factors(spark.createDataFrame(rows, SCHEMA), min_words=8, anchor_words=3).collect()
    check_factors(rows, got, 8)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == h.brute_substrings(rows, 8)


def test_lines_equal_brute_force(docs, rows):
    got = drop_repeated_lines(docs).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in got} == h.brute_lines(rows)


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates_equal_brute_force(docs, rows, shingle):
    got = near_duplicates(docs, shingle).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == h.brute_components(rows, shingle)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_a_group_beyond_one_block(spark):
    """Hundreds of near copies, a chain whose ends aren't alike, and texts that are nothing alike."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(60)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(w), None, None, 0))
    w = [f"c{i}" for i in range(80)]
    for i in range(12):
        w[i * 6] = f"y{i}"
        rows.append((1000 + i, " ".join(w), None, None, 0))
    rows += [(2000 + i, " ".join(f"z{rng.randrange(5000)}" for _ in range(40)), None, None, 0) for i in range(60)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), 2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == h.brute_components(rows, 2)


def one_node(monkeypatch, grp, n):
    """All documents in last-level nodes ``grp``, said to have n members."""
    monkeypatch.setattr(chosen_path, "SUBTREES", 0)  # every large node with anyone outside is branched
    monkeypatch.setattr(chosen_path, "_nodes", lambda reps: reps.select(grp(F.col("id")).cast("long").alias("grp"), "id", F.lit(0).alias("tree"), F.lit(n).cast("long").alias("n")))
    monkeypatch.setattr(chosen_path, "_leaves", lambda large, reps: large.select("grp", "id", F.lit(n).cast("long").alias("n")))


@pytest.mark.parametrize("few", [2048, 100])
def test_near_duplicates_in_a_node_of_unlike_texts(spark, monkeypatch, few):
    """All documents in one last-level node far beyond a block, most of them alike to nothing:
    compared with all, or met by their rarest tokens."""
    monkeypatch.setattr(chosen_path, "FEW", few)
    rng = random.Random(8)
    texts = [[f"u{rng.randrange(100)}" for _ in range(60)] for _ in range(600)]
    for k in range(40):
        texts.append([*texts[k * 10], f"v{k}"])
    rows = [(i, " ".join(w), None, None, 0) for i, w in enumerate(texts)]
    one_node(monkeypatch, lambda id: F.lit(1), len(rows))
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), 2).collect()
    want = h.brute_components(rows, 2)
    assert sum(d != c for d, (_, c) in want.items()) == 40
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def template_pages(n, seed, share=0.44):
    """Pages of one template, alike by ``share`` of their words, and a near copy of every tenth
    page by substituting some words: (rows, similarity of each planted pair)."""
    rng = random.Random(seed)
    frame = [f"t{i}" for i in range(44)]
    rows, pairs = [], []
    for i in range(n):
        own = [f"p{i}x{j}" for j in range(round(44 / share) - 44)]
        rows.append((i, " ".join(frame + own), None, None, 0))
        if i % 10 == 0:
            for j in range(rng.randint(0, 5)):
                own[3 + 2 * j] = f"q{i}x{j}"
            own[-1] += "z"
            rows.append((n + i, " ".join(frame + own), None, None, 0))
            a, b = h.shingles(rows[-2][1], 2), h.shingles(rows[-1][1], 2)
            pairs.append((i, n + i, len(a & b) / len(a | b)))
    return rows, pairs


@pytest.mark.parametrize("small_nodes", [True, False])
def test_recall_by_similarity_among_pages_of_one_template(spark, monkeypatch, small_nodes):
    """Every planted pair of 0.8 or more is found, in each band, and no other; with last-level
    nodes beyond a block, too."""
    rows, pairs = template_pages(2000, 3)
    if not small_nodes:
        one_node(monkeypatch, lambda id: F.when(F.pmod(id, F.lit(20)) < 10, 1).otherwise(2), 1100)
        monkeypatch.setattr(chosen_path, "FEW", 200)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), 2).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        band = [(a, b) for a, b, s in pairs if low <= s < high]
        assert len(band) > 10 and sum(got[b] == a for a, b in band) >= 0.99 * len(band)
    linked = {b for _, b, s in pairs if s >= 0.8}
    assert all(c == d for d, c in got.items() if d not in linked)


def test_pairs_meet_in_leaves_of_the_last_level(spark, monkeypatch):
    """Pairs at 0.8, every node taken for large: fewer than one in a million may be lost, not one in 28."""
    rng = random.Random(11)
    rows = []
    for k in range(1000):
        w = [f"p{k}x{i}" for i in range(91)]
        rows.append((2 * k, " ".join(w), None, None, 0))
        for at in range(5):
            w[at * 18 + rng.randrange(1, 17)] = f"q{k}x{at}"
        rows.append((2 * k + 1, " ".join(w), None, None, 0))
    docs = spark.createDataFrame(rows, SCHEMA).select(F.col("doc_id").alias("id"), "text").repartition(4)
    monkeypatch.setattr(chosen_path, "BLOCK", 1)
    reps = chosen_path._describe(docs, 2)
    met = chosen_path._leaves(chosen_path._nodes(reps), reps).groupBy("grp").agg(F.collect_set("id").alias("ids"))
    pairs = {tuple(sorted(r["ids"])) for r in met.collect()}
    assert len([k for k in range(1000) if (2 * k, 2 * k + 1) in pairs]) == 1000


def test_statistics_equal_brute_force(docs, rows):
    got = {r["doc_id"]: tuple(r[c] for c in STATISTICS) for r in statistics(docs).collect()}
    assert got == {d: h.brute_statistics(t) for d, t, *_ in rows}


@pytest.mark.parametrize("op", [find_factors, drop_repeated_lines, near_duplicates, statistics])
def test_odd_tables(spark, rows, op):
    """Null ids, repeated rows, clashing columns, empty tables: no crash, and every row comes back."""
    odd = [*rows[:20], rows[5], rows[5], (None, rows[4][1], None, None, None), (None, None, None, None, None)]
    df = clash(spark.createDataFrame(odd, SCHEMA))
    out = op(df)
    assert out.count() == len(odd) and out.columns.count("doc_id") == 1
    assert op(df.limit(0)).count() == 0


def test_null_ids_and_repeated_rows_keep_their_text(spark, rows):
    copy = rows[3]
    df = spark.createDataFrame([copy, copy, (None, copy[1], None, None, None)], SCHEMA)
    assert {r["n_removed"] for r in find_factors(df, 5).collect()} == {0}
    assert {r["n_dropped"] for r in drop_repeated_lines(df, min_docs=2).collect()} == {0}
    got = near_duplicates(df).collect()
    assert [r["kept"] for r in got] == [True] * 3 and {r["component_id"] for r in got} == {copy[0], None}


def labelled(spark, n=400):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        w = ["".join(rng.choice("abcdefgh") for _ in range(5)) + ("###" if bad else "") for _ in range(40)]
        rows.append((i, " ".join(w), None, None, 0))
        labels.append((i, int(not bad)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")


def test_rules_are_learned_and_hold_on_other_rows(spark):
    docs, labels = labelled(spark)
    half = labels.where("doc_id < 200")
    out = judge(docs, half).where("doc_id >= 200").join(labels, "doc_id").collect()
    assert all(r["kept"] == bool(r["quality"]) for r in out)
    kept = keep_good(docs, half)
    assert kept.columns == docs.columns and kept.count() == 320


def test_no_labels_no_rules(spark):
    docs, labels = labelled(spark, 40)
    for few in (labels.limit(0), labels.withColumn("quality", F.lit(None).cast("int")), labels.withColumn("quality", F.lit(1))):
        assert learn_rules(statistics(docs), few).rules == []
        assert keep_good(docs, few).count() == 40
    assert DecisionList().keeps() is not None


def test_rules_stay_in_the_jvm(spark):
    docs, labels = labelled(spark, 60)
    plan = statistics(docs).where(base_failed())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
