"""URL filters, whitening and the source audit against brute-force versions."""

import itertools
import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from freshet.llm import queries as q
from freshet.llm import source_audit, url_rules, whitening
from tests.llm.helpers import FOLD

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


# --- URL filters


def brute_host(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(FOLD), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute_declared(url, rules):
    host, path = brute_host(url)
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def brute_tokens(url):
    if url is None:
        return frozenset()
    digits = lambda x: re.sub(r"[0-9]+", "0", x.translate(FOLD))
    host, path = brute_host(url)
    scheme = url.split("://", 1)[0] if "://" in url else ""
    before, _, fragment = url.partition("#")
    parts = [("scheme ", [scheme]), ("host ", host.split(".")), ("path ", re.split(r"[/._-]", path)), ("query ", re.split("[&;]", before.partition("?")[2])), ("fragment ", [fragment])]
    return frozenset(m + digits(x) for m, xs in parts for x in xs if x)


def brute_verdicts(urls, rules, support, confidence, least):
    """Every subset of the tokens of every labelled address, by counting."""
    labelled = [(brute_tokens(u), brute_declared(u, rules)[1]) for u in urls if brute_declared(u, rules)[1]]
    hits, held = Counter(), Counter()
    for tokens, verdict in labelled:
        for k in range(1, len(tokens) + 1):
            for part in itertools.combinations(sorted(tokens), k):
                held[frozenset(part)] += 1
                hits[frozenset(part), verdict] += 1
    found = {(t, v): (n / held[t], n) for (t, v), n in hits.items() if n >= max(support * len(labelled), least) and n / held[t] >= confidence}
    out = []
    for u in urls:
        tokens, best = brute_tokens(u), (0, 0, 0, None)
        for (t, v), (c, n) in found.items():
            if t <= tokens and not any(p < t and v == w and found[p, w][0] >= c for p, w in found):
                best = min(best, (-c, -n, -len(t), v))
        out.append(best[3])
    return out


def test_url_verdicts_equal_enumeration_of_all_combinations(spark):
    urls = [f"http{'s' * (k % 2)}://{h}.example.{t}/{lang}/{k}{end}" for k, (h, t, lang, end) in enumerate(itertools.product(["a", "b"], ["com", "org", "net"], ["de", "fr", "es", "en"], ["", ".html", "#top"]))]
    urls += [None, "", "no address", "x://", "HTTP://A.Example.ORG/ES/1", "https://org/x", "https://norg/x", "a://b://org/", "http://example.org/en/12?x=1#y", "http://x.example.org", urls[0], urls[0]]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(5)
    got = {r["page_id"]: r for r in url_rules.judge_urls(rows, url_rules.URL_RULES, min_support=0.05, min_rows=3).collect()}
    joined = {r["page_id"]: r for r in url_rules.judge_urls(rows, url_rules.URL_RULES, min_support=0.05, min_rows=3, match=url_rules.match_by_join).collect()}
    assert got == joined and len(got) == len(urls)
    mined = brute_verdicts(urls, url_rules.URL_RULES, 0.05, 0.8, 3)
    judged = 0
    for k, url in enumerate(urls):
        rule, verdict = brute_declared(url, url_rules.URL_RULES)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (*brute_host(url), rule)
        if verdict:
            assert got[k]["verdict"] == verdict
        else:
            judged += mined[k] == "block"
            assert got[k]["verdict"] == (mined[k] or "allow")
    assert judged


def test_url_query_equals_enumeration(spark):
    got = {r["page_id"]: r for r in q.op11_url_filters(spark, SF).collect()}
    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    mined = brute_verdicts([u for _, u in pages], url_rules.URL_RULES, 0.01, 0.8, 10)
    assert len(got) == len(pages)
    for (k, url), best in zip(pages, mined, strict=True):
        rule, verdict = brute_declared(url, url_rules.URL_RULES)
        assert (got[k]["rule"], got[k]["verdict"]) == (rule, verdict or best or "allow")


def test_addresses_with_many_constant_tokens(spark):
    same = "/".join(f"part{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(k, f"http://x.org/{same}/{k}") for k in range(40)] + [(100, f"http://other.net/{same}"), (101, "http://plain.net/")]
    out = {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), [("block", "org", "/")]).collect()}
    assert out[0] == out[100] == "block" and len(out) == 42


def test_url_filters_on_odd_tables(spark):
    schema = "page_id long, url string, `tokens` int, `found` string, `rest` int, `mined` int, `verdict` string, `a.b` int"
    rows = [(1, "http://x.org/a", 1, "f", 2, 3, "old", 4), (None, None, None, None, None, None, None, None), (1, "http://x.org/a", 1, "f", 2, 3, "old", 4)]
    out = url_rules.judge_urls(spark.createDataFrame(rows, schema), url_rules.URL_RULES)
    assert sorted(out.columns) == sorted(["page_id", "tokens", "found", "rest", "mined", "a.b", "host", "path", "rule", "verdict"])
    got = sorted(out.collect(), key=str)
    assert [r["verdict"] for r in got] == ["allow"] * 3 and [r["a.b"] for r in got if r["page_id"]] == [4, 4] and {r["found"] for r in got if r["page_id"]} == {"f"}
    for rules in (url_rules.URL_RULES, ()):
        assert url_rules.judge_urls(spark.createDataFrame([], schema), rules).collect() == []
    assert [r["rule"] for r in url_rules.judge_urls(spark.createDataFrame(rows, schema), ()).collect()] == [None] * 3
    with pytest.raises(ValueError):
        url_rules.judge_urls(spark.createDataFrame(rows, schema), [("deny", "org", "/")])
    long = "http://x.net/" + "w/" * 200_000
    assert url_rules.judge_urls(spark.createDataFrame([(1, long)], "page_id long, url string"), url_rules.URL_RULES).first()["path"] == long[12:]


# --- whitening


def brute_whitening(vectors, scale=256.0, k=4):
    """(n, deviation by row, whitened by row, explained) by NumPy's own eigen-solver and exact fractions."""
    x = [tuple(math.floor(scale * float(c)) for c in v) for v in vectors]
    distinct = sorted(set(x))
    n, sums = len(distinct), [sum(col) for col in zip(*distinct, strict=True)]
    centred = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(r, sums, strict=True)] for r in distinct])
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1][:k], directions[:, ::-1][:, :k]
    own = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(r, sums, strict=True)] for r in x])
    return n, [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x], own @ directions / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def held_against_brute(rows, got, k=4):
    n, deviation, whitened, explained = brute_whitening([v for _, v in rows], k=k)
    table = {(r["vec_id"], r["component"]): r for r in got}
    assert len(table) == len(got) == len(rows) * k
    for c in range(k):
        signs = [table[i, c + 1]["whitened"] * whitened[at, c] for at, (i, _) in enumerate(rows)]
        sign = 1 if sum(signs) >= 0 else -1
        for at, (i, _) in enumerate(rows):
            r = table[i, c + 1]
            assert (r["n"], r["deviation"]) == (n, deviation[at])
            assert r["whitened"] == pytest.approx(sign * whitened[at, c], abs=1e-8)
            assert r["explained"] == pytest.approx(explained[c], rel=1e-9) and r["identity_error"] < 1e-9


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 7)) * [9, 5, 3, 2, 1, 0.5, 0.1] + rng.normal(size=7) * 100
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate([*data, *data[:40], *[data[0]] * 50])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(9)).collect()
    held_against_brute(rows, got)


def test_whitening_query_equals_numpy(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    held_against_brute(rows, q.op12_embedding_whitening(spark, SF).collect())


def test_moments_merge_like_one_stream():
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (200, 5)) + 10**9
    one, parts = whitening.Moments(5), whitening.Moments(5)
    one.add(x)
    for a, b in ((0, 1), (1, 1), (1, 120), (120, 200)):
        m = whitening.Moments(5)
        m.add(x[a:b])
        batch = whitening._pack({5: m}, 0)
        parts.merge(dict(whitening._unpack(batch.to_pylist()))[5])
    assert parts.n == one.n and parts.sums == one.sums == x.sum(0).tolist()
    assert np.allclose(parts.covariance(), np.cov(x.T, bias=True), rtol=1e-9) and np.allclose(one.covariance(), parts.covariance(), rtol=1e-9)


@pytest.mark.parametrize("size", [1, 2, 3, 20, 90])
def test_qr_equals_eigh(size):
    rng = np.random.default_rng(size)
    for a in (rng.normal(size=(size, size)), np.outer(*[np.arange(1.0, size + 1)] * 2), np.diag(np.round(rng.normal(size=size))), np.zeros((size, size)), rng.normal(size=(size, size)) * 1e-170):
        a = a + a.T
        values, vectors = whitening.symmetric_qr(a)
        top = max(np.abs(a).max(), 1e-300)
        assert np.allclose(values / top, np.linalg.eigvalsh(a / top)[::-1], atol=1e-12 * size)
        assert np.allclose(vectors @ vectors.T, np.eye(size), atol=1e-12) and np.allclose(vectors @ (a / top), (values / top)[:, None] * vectors, atol=1e-12 * size)


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, x int, rest string, n string, `size` int, `a.b` int"
    odd = [(1, None), (2, [1.0, None]), (3, [1.0, float("nan")]), (4, [float("inf"), 1.0]), (5, [])]
    rows = [(i, v, 1, "r", "n", 2, 3) for i, v in odd]
    assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    rows += [(None, [-0.0, 1.0], 1, "r", "n", 2, 3), (7, [0.0, 1.0], 1, "r", "n", 2, 3), (8, [2.0, 1.0], 1, "r", "n", 2, 3), (9, [5.0], 1, "r", "n", 2, 3)]
    out = whitening.whiten(spark.createDataFrame(rows, schema))
    assert sorted(out.columns) == sorted(["vec_id", "x", "rest", "size", "a.b", *whitening.OWN])
    got = {(r["vec_id"], r["component"]): r for r in out.collect()}
    assert set(got) == {(i, c) for i in (None, 7, 8) for c in (1, 2)} | {(9, 1)}
    first = got[None, 1]
    assert first["n"] == 2 and first["deviation"] == 512**2 and abs(first["whitened"]) == pytest.approx(1) and first["explained"] == 1.0 and first["identity_error"] == pytest.approx(0)
    assert (first["rest"], first["x"], first["a.b"], first["size"]) == ("r", 1, 3, 2)
    assert got[7, 2]["whitened"] is None and got[7, 2]["explained"] == 0.0
    assert (got[9, 1]["n"], got[9, 1]["deviation"], got[9, 1]["whitened"], got[9, 1]["explained"], got[9, 1]["identity_error"]) == (1, 0, None, None, None)
    for vectors in ([[1e30], [0.0]], [[1e16], [0.0]]):
        with pytest.raises(Exception, match="beyond a long"):
            whitening.whiten(spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")).collect()


def test_wide_sums_stay_exact(spark):
    rows = [(k, [float(2**52 - k), float(k)]) for k in range(3000)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), scale=1.0).where("component = 1").collect()
    n, sums = 3000, (sum(2**52 - k for k in range(3000)), sum(range(3000)))
    assert {r["vec_id"]: r["deviation"] for r in out} == {k: (n * (2**52 - k) - sums[0]) ** 2 + (n * k - sums[1]) ** 2 for k in range(3000)}


# --- source audit


def brute_audit(rows, least=10, top=10):
    docs, counts = {}, {}
    for text, lang, source in rows:
        c = Counter(w.translate(FOLD) for w in TERM.findall(text or ""))
        counts.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(c)
        docs.setdefault(lang or "", Counter()).update(set(c))
    out = set()
    for lang, sources in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        p = {}
        for name, c in [*sources.items(), (None, sum(sources.values(), Counter()))]:
            total = sum(c[t] for t in kept) + 2 * len(kept)
            p[name] = {t: 1 + 1_000_000_000 * (c[t] + 2) // total for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for name in sources:
            pairs = [(-sum(f(p[name][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != name]
            terms = [(-f(p[name][t], p[None][t]), t.encode()) for t in kept if sources[name][t] and p[name][t] > p[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, name, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)}
    return out


def audited(df, **how):
    rows = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in source_audit.audit_sources(df, **how).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_audit_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = ["Alpha", "beta", "GAMMA", "délta", "été", "Été", "漢字", "x", "y", "zz", "don", "t"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(" ".join(rng.choice(vocab, rng.integers(0, 40), p=None)) + rng.choice(["", "don't-stop\tX9y\x00b", "\n"]), str(rng.choice(["en", "de"])), str(rng.choice(["s1", "s2", "s3", "é"]))) for _ in range(300)]
    rows += [(None, "en", "s1"), ("alpha " * 30, None, None), (None, None, "only"), ("rare words here", "fr", "a"), ("other", "fr", "b"), ("", "it", "alone"), ("beta " * 5000, "en", "s1"), rows[0], rows[0]]
    df = spark.createDataFrame([(r[0], r[1], r[2], k) for k, r in enumerate(rows)], "text string, lang string, source string, n int")
    want = brute_audit(rows)
    assert audited(df.repartition(7)) == want
    assert audited(df.coalesce(1), top=3, min_docs=1) == brute_audit(rows, 1, 3)


def test_audit_in_small_parts(spark, monkeypatch):
    """Texts longer than a chunk, chunks of few texts, matrices in tiles."""
    rng = np.random.default_rng(6)
    rows = [(" ".join(rng.choice(["ab", "é漢", "cd", "ef", "verylongterm" * 9], 60)), "en", f"s{k % 3}") for k in range(60)]
    monkeypatch.setattr(source_audit, "CHUNK", 64)
    monkeypatch.setattr(source_audit, "TILE", 16)
    found = {}
    for text, _, _ in rows:
        words, n = source_audit.count_long(np.frombuffer(text.encode(), np.uint8))
        assert {w.decode(): k for w, k in zip(words, n.tolist(), strict=True)} == Counter(TERM.findall(text))
    for data in ([t for t, _, _ in rows],):
        raw = "".join(data).encode()
        ends = np.cumsum([0, *(len(t.encode()) for t in data)])
        starts, to, text = source_audit.find_terms(np.frombuffer(raw, np.uint8), ends)
        assert [(raw[a:b].decode(), k) for a, b, k in zip(starts.tolist(), to.tolist(), text.tolist(), strict=True)] == [(w, k) for k, t in enumerate(data) for w in TERM.findall(t)]
    csr = source_audit.Csr(np.array([0, 0, 2, 2, 3]), np.array([0, 3, 1, 3, 0]), np.array([5, 1, 7, 2, 9]), np.array([20, 14, 25, 30]), 4)
    dense = np.array([source_audit.shares(np.array(c), t) for c, t in (([5, 0, 0, 1], 20), ([0, 0, 0, 0], 14), ([0, 7, 0, 2], 25), ([9, 0, 0, 0], 30))])
    for i in range(4):
        assert csr.apart(i).tolist() == [int(source_audit.divergence(dense[i], dense[j]).sum()) for j in range(i + 1, 4)]
    assert not found


def test_slices_of_one_hash_are_told_apart():
    raw = b"ab cd ab ef cd abc ab gh"
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = source_audit.find_terms(data, np.array([0, len(raw)]))
    for digest in (lambda s: 1, lambda s: len(s), lambda s: s[0]):
        group, first = source_audit.group_slices(data, starts, ends, digest)
        words = [raw[a:b] for a, b in zip(starts, ends, strict=True)]
        assert [words[first[g]] for g in group] == words and len(first) == len(set(words))


def test_shares_are_exact():
    for count in (0, 1, 999, 10**12, 9 * 10**14):
        for total in (count + 2, count + 3, 2 * count + 7, 9 * 10**15):
            assert source_audit.shares(np.array([count]), total)[0] == 1 + 10**9 * (count + 2) // total
    with pytest.raises(OverflowError):
        source_audit.shares(np.array([1]), 10**17)


def test_audit_of_odd_tables(spark):
    schema = "text string, lang string, source string, `term` int, `docs` string"
    assert audited(spark.createDataFrame([], schema)) == set()
    rows = [("a", "en", "x", 1, "d"), ("a", "en", "y", 1, "d"), ("", "de", "z", None, None)]
    assert audited(spark.createDataFrame(rows, schema)) == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}
