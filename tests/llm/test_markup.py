"""Markup that no one should write: every page is read, in time that grows with its length."""

import random
import time

import pytest

from freshet.llm.html_layout import declared_language, extract_text, parse, render

PAGES = "/root/testdata/sf0.001/pages.parquet"

#: (page, what it shows) by the states of the HTML standard's tokenizer.
SHOWN = [
    ("x<![ if gte mso 9]>y", "xy"), ("<![foo[x]]>", ""), ("<![5]>z", "z"), ("a<![<b>c", "ac"), ("<!x>a<!doctype html>b", "ab"), ("a<?x c>b", "ab"), ("<?x c", ""), ("a</>b", "ab"), ("a</ x>b", "ab"),
    ("1 < 2 <3", "1 < 2 <3"), ("a<", "a<"), ("a</", "a</"), ("a<p", "a"), ("<!-->a", "a"), ("<!--->b", "b"), ("<!--x--!>c", "c"), ("<!-- -- > --x -->d", "d"), ("a<!--b", "a"), ("<!-- <!-- -->e", "e"),
    ("<script><!--<script></script>--></script>d", "d"), ("<script>a</script >e", "e"), ("<script><!--></script>f", "f"), ("<style><p></style>g", "g"), ("<title><b></title>h", "h"), ("<textarea><b>&lt;</textarea>f", "<b><f"), ("<xmp><b>&lt;</xmp>", "<b>&lt;"),
    ("<plaintext>a</plaintext><b>", "a</plaintext><b>"), ("<a href=x/>g</a>", "g"), ("<a title='>' x=\">\">i", "i"), ("<input value=a value=b>", "a"), ('<input value="&copy=1&amp;x&lt">', "&copy=1&x<"), ("<input value=>j", "j"), ("<a =b c>k", "k"), ("<A\nB>l</A\n>", "l"),
    ("&#" + "1" * 5000 + ";x", "�x"), ("&#0000000065;&#x000000041;", "AA"), ("&#00000000038;amp;", "&amp;"), ("a&nosuch;&b&", "a&nosuch;&b&"),
    ("<svg><text><![CDATA[hi <b>]]></text></svg>", "hi <b>"), ("<p><![CDATA[hi]]>j", "j"), ("<svg><text><![CDATA[hi", "hi"), ("<svg/>k", "k"), ("<svg><title>x</title></svg>m", "m"), ("a\r\nb", "a b"),
]


@pytest.mark.parametrize(("page", "shown"), SHOWN)
def test_states_of_the_tokenizer(page, shown):
    assert render(parse(page)) == shown


def test_odd_pages_leave_good_ones_alone(spark):
    rows = [(k, p) for k, (p, _) in enumerate(SHOWN)] + [(-1, "<p>ok")]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, html string").coalesce(1)).collect()}
    assert got == {k: s for k, (_, s) in enumerate(SHOWN)} | {-1: "ok"}


@pytest.mark.parametrize("part", ["<!--", "<a ", "<![", "</", "<?", "&", "<", "&#1", '<a b="', "<a b='", "<a b=c ", "<!--->", "<!-- --!", "<script>", "<script><!--", "<textarea>", "<title><!--", "<![CDATA[", "<svg><![CDATA[", "/", "<a/", "</p", "]]>"])
def test_a_megabyte_of_it(part):
    page = part * (1_000_000 // len(part))
    began = time.process_time()
    render(parse(page))
    assert time.process_time() - began < 2 * (5 if part.startswith("<svg") else 1)


def test_mutated_pages_are_read(spark):
    rng = random.Random(4)
    pages = [r["html"] for r in spark.read.parquet(PAGES).collect() if r["html"]]
    bits = ["<", ">", "!", "-", "--", "[", "&", '"', "'", "=", "/", "<!", "<?", "</", "<![CDATA[", "]]>", "<script", "<svg", "<table", "<td", "<li", "<select", "<option", "&#", "&#x", "\0", "\r"]
    for _ in range(3000):
        chars = list(rng.choice(pages))
        at = rng.randrange(max(len(chars) - 400, 1))
        chars = chars[at : at + 400]
        for _ in range(rng.randint(1, 8)):
            k = rng.randrange(len(chars) + 1)
            if rng.random() < 0.6:
                chars[k:k] = rng.choice(bits)
            else:
                del chars[k : k + rng.randint(1, 9)]
        root = parse("".join(chars))
        assert isinstance(render(root), str) and (declared_language(root) or "x").islower()
