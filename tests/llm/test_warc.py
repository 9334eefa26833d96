import gzip
import time
from html.parser import HTMLParser

import pytest

from geoskein.llm import warc

PAGE = '<!DOCTYPE html><html lang="fr"><head><title>A &amp; B</title><script>var t="</p>";</script></head><body><!-- no --><p>one <b>two</b>&nbsp;three<br>four<script>x</script></p><a href="/l?a&amp;b">link</a> 1 &lt; 2</body></html>'


class Plain(HTMLParser):
    """Text outside hidden elements, for comparing words."""

    def __init__(self):
        super().__init__()
        self.hidden, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head", "template", "noscript")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head", "template", "noscript") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def test_text_and_links():
    assert warc.text_of(PAGE) == "one two three\nfour\nlink 1 < 2"
    meta, conv = warc.derive(warc.response("http://x/", PAGE))
    fields = [line.split(": ", 1) for line in meta["block"].decode().splitlines()]
    assert ["title", "A & B"] in fields and ["language", "fr"] in fields and ["outlink", "/l?a&b"] in fields
    assert conv["block"].decode() == warc.text_of(PAGE)


def test_text_of_real_pages_has_the_words_of_a_parser(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(60).collect():
        p = Plain()
        p.feed(r.html)
        assert "".join(warc.text_of(r.html).split()) == "".join("".join(p.words).split())


def test_round_trip_and_links_of_records():
    source = warc.response("http://x/é", PAGE, "7")
    made = [source, *warc.derive(source)]
    for compress in (False, True):
        back = warc.parsed(b"".join(warc.serialised(r, compress) for r in made))
        assert back == made
    for d in made[1:]:
        assert d["headers"]["WARC-Refers-To"] == source["record_id"] and d["headers"]["WARC-Source-Payload-Digest"] == source["headers"]["WARC-Payload-Digest"]
        assert d["headers"]["WARC-Block-Digest"] == warc.digest(d["block"])
    assert len({r["record_id"] for r in made}) == 3


def test_other_payloads():
    body = "café".encode("latin-1")
    block = b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(body)
    source = {"record_id": "<urn:x>", "rec_type": "response", "target_uri": "u", "warc_date": "d", "headers": {"X-Own": "1"}, "block": block}
    meta, conv = warc.derive(source)
    assert conv["block"].decode() == "café" and b"source-x-own: 1" in meta["block"]
    assert warc.derive(source | {"block": None, "headers": None})[1]["block"] == b""


def test_frames(spark):
    rows = [(1, "http://a/", PAGE, 3), (2, None, "x " * 200_000, 3), (3, "http://b/", None, 3), (3, "http://b/", None, 3), (None, "http://c/", "", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block int")
    derived = warc.derivatives(warc.responses(pages).drop("id"))
    got = warc.page_derivatives(pages)
    assert derived.count() == got.count() == 10
    assert got.filter("rec_type = 'conversion' and page_id = 3").select("record_id").distinct().count() == 1
    texts = {r.target_uri: bytes(r.block).decode() for r in derived.filter("rec_type = 'conversion'").collect()}
    assert texts["http://a/"] == warc.text_of(PAGE) and texts["http://b/"] == ""
    blob = b"".join(bytes(r.bytes) for r in warc.files(derived).collect())
    assert len(warc.parsed(blob)) == 10
    assert warc.page_derivatives(pages.limit(0)).count() == 0


def test_unclosed_heads_and_templates_hide_no_body():
    head = '<html><head><meta charset="utf-8"><title>A</title><!-- <p> --><script>"<p></head>"</script><noscript><link></noscript>\n<style>p {}</style><link rel="x" href="y">'
    for rest in ("<body><p>one</p>two</body></html>", "<p>one</p>two", "<div>one</div>two<header>", "</head><body><p>one</p>two", "</HEAD ><p>one<p>two", "one<p>two"):
        assert warc.text_of(head + rest) == "one\ntwo"
    assert warc.text_of("<head><title>A<body><p>one") == "A\none"
    for name in ("noscript", "template"):
        assert warc.text_of(f"<p>one<{name}>two</p><p>three") == "onetwo\nthree" and warc.text_of(f"<p>one<{name}>two</{name}></p><p>three") == "one\nthree"
    assert warc.text_of("<header>one</header><p>two") == "one\ntwo"
    conv = warc.derive(warc.response("http://x/", head + "<body>" + "word " * 50))[1]
    assert conv["block"].decode().split() == ["word"] * 50


@pytest.mark.parametrize("piece", ["<a ", "<p ", "<a href", "<a href=\"", "<a href='x", "<template>", "<noscript><p>", "<title>", "<title ", "<head>", "<head><title>", "<script ", "<html ", "<html lang", "<!--", "<style>", "< ", "<!", "</", "&", "</template><template>", "lang="])
def test_hostile_pages_take_linear_time(piece):
    for page in (piece * (1_000_000 // len(piece)), "<head>" + piece * (1_000_000 // len(piece)) + "</noscript>"):
        began = time.process_time()
        warc.derive(warc.response("http://x/", page))
        assert time.process_time() - began < 2


def test_cut_and_repeated_gzip_members():
    words = " ".join(str(k * k) for k in range(9000)).encode()
    whole = gzip.compress(words)
    assert warc.inflated(whole) == words and warc.inflated(whole + gzip.compress(b"more")) == words + b"more"
    cut = warc.inflated(whole[: len(whole) // 2])
    assert len(cut) > len(words) // 4 and words.startswith(cut)
    broken = bytearray(whole)
    broken[len(whole) // 2] ^= 0xFF
    assert words[:1000] == warc.inflated(bytes(broken))[:1000] and warc.inflated(b"") == warc.inflated(b"plain") == b""
    assert warc.payload_text([("Content-Encoding", "gzip")], whole[:-9]) == words.decode()[: len(warc.inflated(whole[:-9]))] != ""
