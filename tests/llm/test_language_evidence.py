"""Language identification against a second computation of the posterior, and on documents that it didn't see."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.llm import language_id as li
from freshet.llm import queries as q
from freshet.llm.html_layout import declared_language, parse, render

SF = "/root/testdata/sf0.001"


def posterior(evidence, n, host_weight=4.0, domain_weight=8.0, smoothing=1.0):
    """Posteriors in NumPy from (host, domain, suffix, declared, text posterior) of every row."""
    soft = np.exp(np.array([e[4] for e in evidence]))
    sums = [defaultdict(lambda: np.zeros(n)) for _ in range(4)]
    for e, s in zip(evidence, soft, strict=True):
        for k in range(4):
            sums[k][e[k]] = sums[k][e[k]] + s
    base = soft.sum(0) + smoothing
    base = base / base.sum()
    out = []
    for e, s in zip(evidence, soft, strict=True):
        others = [np.maximum(sums[k][e[k]] - s, 0) for k in range(4)]
        number = [max(sums[k][e[k]].sum() - 1, 0) for k in range(4)]
        domain = (others[1] + domain_weight * base) / (number[1] + domain_weight)
        host = (others[0] + host_weight * domain) / (number[0] + host_weight)
        score = np.array(e[4]) + np.log(host if e[0] else base)
        for k in (2, 3):
            if e[k]:
                score = score + np.log((others[k] + smoothing * base) / (number[k] + smoothing) / base)
        p = np.exp(score - score.max())
        out.append(p / p.sum())
    return np.array(out)


def test_posteriors_of_all_pages_and_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    languages, model = li.fit_text_model(docs.select("text", "lang"))
    got = q.op9_language_id(spark, SF).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    texts = {r["doc_id"]: r for r in docs.collect()}
    trees = {k: parse(r["html"] or "") for k, r in pages.items()}
    evidence = {k: (*li.address(r["url"]), declared_language(trees[k]) or "", li.text_posterior(render(trees[k]), model)) for k, r in pages.items()}
    for name, rows in (("page_id", evidence), ("doc_id", {k: (r["source"] or "", "", "", "", li.text_posterior(r["text"] or "", model)) for k, r in texts.items()})):
        want = dict(zip(rows, posterior(list(rows.values()), len(languages)), strict=True))
        mine = {r[name]: r for r in got if r[name] is not None}
        assert set(mine) == set(want)
        for k, p in want.items():
            assert mine[k]["lang"] == languages[int(np.argmax(p))] and mine[k]["confidence"] == pytest.approx(p.max(), abs=1e-9)


def test_documents_that_the_model_did_not_see(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").where("lang IS NOT NULL AND length(text) >= 100")
    third = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = li.fit_text_model(docs.where(~third))
    unseen = docs.where(third).withColumnRenamed("lang", "truth")
    rows = li.identify_texts(unseen, model).collect()
    assert len(rows) == unseen.count() > 30 and sum(r["lang"] == r["truth"] for r in rows) >= 0.98 * len(rows)


def test_many_languages_compile(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k % 7)} " * 8, f"l{k:03d}", f"h{k % 9}", "x") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `_text` string")
    model = li.fit_text_model(docs)
    assert len(model[0]) == 500
    out = li.identify_texts(docs.withColumnRenamed("lang", "truth").limit(20), model).collect()
    assert len(out) == 20 and all(r["lang"] in model[0] and r["_text"] == "x" for r in out)
