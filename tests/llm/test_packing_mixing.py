import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from freshet.llm import mixing, packing
from freshet.llm.queries import tokenizer_path
from tests.llm import helpers as h


def check_places(rows, caps):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= caps.tokens and len(parts) <= (caps.documents or caps.tokens)
        assert sum(n * n for _, n in parts) <= (caps.attention or caps.tokens**2)
    return len(bins)


@pytest.mark.parametrize("caps", [packing.Capacities(100), packing.Capacities(100, rule="norm"), packing.Capacities(100, documents=4), packing.Capacities(100, attention=3000, documents=9)])
def test_bins_keep_every_capacity(spark, caps):
    rng = random.Random(2)
    most = int(min(caps.tokens, (caps.attention or caps.tokens**2) ** 0.5))
    rows = [(i, 0, rng.choice([7, 7, 7, rng.randint(1, most)])) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long").withColumn("offset", F.lit("x"))
    out = packing.pack_pieces(df, caps=caps).collect()
    assert len(out) == 2000
    n = check_places(out, caps)
    if caps.documents is None and caps.attention is None:
        assert n <= 1.02 * sum(r[2] for r in rows) / 100 + 1
    with pytest.raises(ValueError):
        packing.bin_shapes({most + 1: 1}, caps)


def test_word_by_word_ids_are_the_tokenizers_ids():
    texts = [t or "" for _, t, *_ in h.corpus()] + [
        "<|endoftext|> x", "á b ́c", "it's 's x's 1234 ab12", "\x1c#\x1c#  z y", "ΟΔΟΣ ΟΔΟΣ. Σ", "İstanbul ẞ ﬁ", "<|startoftext|>x<|endoftext|>y", "a\tb\r\nc", "가 각", "...\n\n  ,,,",
        "foo<|endoftext|>", "'S 'T I'M Don't", "x <|END", "<|EndOfText|>", "ª º ² ½x µ", "naïve,café;déjà--vu.", "a_b __ x_", "\x85a\xa0b",
    ]
    path = tokenizer_path()
    assert packing.goes_by_word(path)
    assert packing.encode_texts(texts, path, by_word=True) == packing.encode_texts(texts, path)


def test_other_tokenizers_go_whole(tmp_path):
    """Any other normalizer, splitter, model or special token: not word by word."""
    import public_tokenizers

    assert not packing.goes_by_word(public_tokenizers.path("byte_bpe_50k.json"))
    with open(tokenizer_path(), encoding="utf-8") as f:
        form = json.load(f)
    token = form["added_tokens"][0]
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "ByteLevel"}}, {"model": {**form["model"], "dropout": 0.1}}, {"added_tokens": [{**token, "content": "of the"}]}, {"truncation": {"max_length": 8}}):
        other = tmp_path / "t.json"
        other.write_text(json.dumps({**form, **change}), encoding="utf-8")
        assert not packing.goes_by_word(str(other))


def test_words_in_memory_are_bounded(monkeypatch):
    path = tokenizer_path()
    _, known, held = packing._encoder(path)
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 50_000)
    rng = random.Random(1)
    for k in range(20):
        texts = [" ".join("".join(rng.choice(rng.choice(["abcdef1+", "abc"])) for _ in range(rng.choice([5, 40, 3000]))) + rng.choice(["", "+"]) for _ in range(30)) for _ in range(3)]
        assert packing.encode_texts(texts, path, by_word=True) == packing.encode_texts(texts, path)
        assert max(map(len, known)) <= packing.REMEMBERED_CHARS and (k == 0 or held[0] < 150_000)
    assert [b - a for a, b in packing._batches(["x" * 3_000_000] * 3 + ["y"] * 600)] == [1, 1, 512, 89]


def test_documents_come_back_whole(spark):
    rows = h.corpus()
    df = spark.createDataFrame([*rows, rows[0]], h.SCHEMA).withColumn("piece", F.lit(1)).repartition(3)
    path, caps = tokenizer_path(), packing.Capacities(512)
    pieces = packing.tokenize_pieces(df, path, 512).collect()
    whole = {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        assert p["length"] * 4 == len(p["ids"]) and p["start"] == p["piece"] * 512
        whole.setdefault(p["doc_id"], {})[p["start"]] = bytes(p["ids"])
    want = packing.encode_texts([t or "" for _, t, *_ in rows], path)
    assert {d: b"".join(x.values()) for d, x in whole.items()} == {r[0]: e + b"\1\0\0\0" for r, e in zip(rows, want, strict=True)}
    out = packing.pack_documents(df, path, caps).collect()
    check_places(out, caps)
    crc = {(p["doc_id"], p["piece"]): zlib.crc32(p["ids"]) for p in pieces}
    assert all(r["ids_crc32"] == crc[r["doc_id"], r["piece"]] for r in out) and len(out) == len(pieces)
    assert packing.pack_documents(df.limit(0), path).count() == 0


def test_targets():
    assert mixing.fill_targets([80, 10, 10], [5, 2, 1], 3) == pytest.approx([62.5, 25, 12.5])
    got = mixing.fill_targets([5, 90, 5], [5, 2, 1], 3)
    assert got[0] == 15 and sum(got) == pytest.approx(100) and got[2] <= 15
    assert mixing.fill_targets([], [], 3) == []
    assert mixing.fill_targets([0, 0], [5, 2], 3) == [0, 0]


def test_flow_uses_first_copies_first_and_shares_overlaps():
    flows = mixing.route({"ab": 100, "b": 50}, {"ab": ["a", "b"], "b": ["b"]}, {"a": 80, "b": 60}, 3)
    assert flows["ab"]["a"] == 80 and flows["ab"].get("b", 0) + flows["b"]["b"] == 60
    assert sum(flows["ab"].values()) <= 100 and flows["b"]["b"] <= 50  # nothing is used twice while there is enough
    flows = mixing.route({"a": 10}, {"a": ["a"]}, {"a": 100}, 3)
    assert flows["a"]["a"] == 30


def test_mix_nears_targets_and_repeats_itself(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 60), None, rng.choice(["a", "a", "a", "b", None]), 0) for i in range(3000)]
    df = spark.createDataFrame(rows, h.SCHEMA).withColumn("taken", F.lit("x"))
    out = mixing.mix_sources(df, F.array("source")).collect()
    size = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in ("a", "b", None)}
    want = dict(zip(("a", "b", None), mixing.fill_targets(list(size.values()), [5, 2, 1], 3), strict=True))
    for s in size:
        mine = [r for r in out if r["source"] == s]
        assert {r["source_size"] for r in mine} == {size[s]} and mine[0]["target"] == pytest.approx(want[s])
        assert sum(r["taken"] for r in mine) == pytest.approx(want[s], rel=0.01)
        assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in mine)
    again = mixing.mix_sources(df.repartition(7), F.array("source")).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in out) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_mix_odd_tables(spark):
    rows = [*h.corpus()[:20], (None, "a b", None, None, None), (None, None, None, "s1", None), h.corpus()[0]]
    df = spark.createDataFrame(rows, h.SCHEMA)
    assert mixing.mix_sources(df, F.array("source")).count() == len(rows)
    assert mixing.mix_sources(df.limit(0), F.array("source")).count() == 0
    both = mixing.mix_sources(df, F.array(F.lit("x"), F.col("source"))).agg(F.sum("taken"), F.sum("size")).first()
    assert both[0] == pytest.approx(both[1], rel=0.2)
    with pytest.raises(ValueError):
        mixing.mix_sources(df, F.array("source"), max_patterns=2)


def test_mix_keeps_sources_of_empty_texts(spark):
    rows = [(1, "a b c", None, "a", 0), (2, "d", None, "a", 0), (3, None, None, "b", 0), (4, " \n ", None, "b", 0), (5, "", None, None, 0)]
    df = spark.createDataFrame(rows, h.SCHEMA)
    out = mixing.mix_sources(df, F.array("source")).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 2, 3, 4, 5]
    assert {(r["source_size"], r["target"], r["taken"]) for r in out if r["source"] != "a"} == {(0, 0.0, 0)}
    assert {r["doc_id"]: r["taken"] for r in mixing.mix_sources(df.where("doc_id > 2"), F.array("source")).collect()} == {3: 0, 4: 0, 5: 0}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fill_goes_on_past_long_documents(spark, seed):
    """What is left open is less than any unused document, wherever the long ones come in seeded order."""
    rng = random.Random(seed)
    sizes = {"a": [300] * 200 + [200_000], "b": [rng.choice([5, 700, 9_000, 40_000]) for _ in range(200)]}
    quota = {"a": 80_000, "b": 123_456}
    rows = [(p, i, n, rng.randrange(2**40)) for p in sizes for i, n in enumerate(sizes[p])]
    slim = spark.createDataFrame(rows, "_pattern string, _id long, _size long, _u long").withColumn("_bucket", F.pmod("_u", F.lit(mixing.BUCKETS)))
    cuts, extra = mixing._fill(slim, quota)
    takes = lambda p, n, u: any(n <= m and (u % mixing.BUCKETS < c or (u % mixing.BUCKETS == c and last is not None and u <= last)) for m, c, last in cuts[p]) or u == extra.get(p)
    for p in sizes:
        taken = [n for q, _, n, u in rows if q == p and takes(p, n, u)]
        unused = [n for q, _, n, u in rows if q == p and not takes(p, n, u)]
        assert p != "a" or sum(taken) == 60_000
        assert abs(quota[p] - sum(taken)) < min(unused)


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_goes_on_past_a_very_long_document(spark, seed):
    rows = [*[(i, None, None, "a", 300) for i in range(1000)], (1000, None, None, "a", 1_000_000), *[(2000 + i, None, None, "b", 700) for i in range(1000)]]
    out = mixing.mix_sources(spark.createDataFrame(rows, h.SCHEMA), F.array("source"), weights=(1, 4), size=F.col("n_chars"), seed=seed)
    assert {r["source"]: (r["target"], r["t"]) for r in out.groupBy("source", "target").agg(F.sum("taken").alias("t")).collect()} == {"a": (400_000, 300_000), "b": (1_600_000, pytest.approx(1_600_000, abs=350))}
