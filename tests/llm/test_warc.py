import base64
import hashlib
import json
import time
from html.parser import HTMLParser

from depthframe.llm.warc import derivatives, page_links, plain_text, read_warc, responses, title, write_warc

BLOCKS = set("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table tbody td tfoot th thead tr ul".split())
HIDDEN = {"script", "style", "noscript", "template", "svg", "iframe", "head"}


class Reader(HTMLParser):
    """The same text by a parser of its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN
        self.out.append("\n" if tag in BLOCKS else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in HIDDEN
        self.out.append("\n" if tag in BLOCKS else "")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def by_parser(page):
    r = Reader()
    r.feed(page)
    r.close()
    return "\n".join(x for x in (" ".join(x.split()) for x in "".join(r.out).split("\n")) if x)


def test_text_of_pages(spark, testdata):
    pages = spark.read.parquet(f"{testdata}/sf0.01/pages.parquet").collect()
    same = sum(plain_text(p.html) == by_parser(p.html) for p in pages)
    assert same == len(pages)


def test_text_edges():
    assert plain_text("") == "" and plain_text("<p>a<br>b &amp;lt; c</p>d") == "a\nb &lt; c\nd"
    assert plain_text("x<script>never closed <p>y") == "x" and plain_text("a <!-- b") == "a" and plain_text("a < b") == "a < b"
    assert title("<TITLE>\n a &amp; b </TITLE>") == "a & b" and page_links("<a href='x?a=1&amp;b=2'>") == ["x?a=1&b=2"]
    assert len(plain_text("<p>" * 100_000 + "x")) == 1
    assert plain_text("<head><title>t</title><meta a=b><p>shown") == "shown" and plain_text("<head>x<body>y") == "y"
    assert plain_text("<head><script>'<div>'</script><title>q</title></head>z") == "z" and plain_text("<header>h</header>") == "h"
    assert plain_text("a<svg width=1 />b<svg><path/>c</svg>d") == "a b d" and plain_text("<noscript>e <iframe src=x>f") == "e f"


OPEN = ["<svg>x", "<svg ", "<noscript>x", "<title>", "<title ", "<template>y", "<iframe>", "<a ", "<a href=", "<a href='", "<a href ", "<a>", "<head", "<head>", "<!--", "<script", "<style ", "</svg", "<p", "<", "href=", "<svg></noscript>"]


def test_pages_of_open_tags_take_time_by_length():
    def seconds(page):
        start = time.process_time()
        plain_text(page), title(page), page_links(page)
        return time.process_time() - start

    for piece in OPEN:
        small, large = (min(seconds(piece * n) for _ in range(2)) for n in (20_000, 80_000))
        assert large < 12 * small + 0.1, piece
    assert plain_text("<svg>x" * 1000) == " ".join("x" * 1000) and page_links("<a <a href=x> <a href=\"y>z\"><a <a>") == ["x", "y>z"]
    assert plain_text("a<svg>b<noscript>c</noscript>d</svg>e<iframe>f<!-- g") == "a e f" and plain_text("a<svg>b</p c<svg <!-- d") == "a b"


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_records(spark, tmp_path):
    rows = [(1, "http://a/", "<title>t</title><p>é\r\n\r\nx <a href=/b>l</a></p>"), (2, None, None), (2, None, None), (None, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS block", "2 AS record_id")
    source = {r.record_id: r for r in responses(pages).collect()}
    assert len(source) == 3
    found = derivatives(responses(pages))
    got = found.collect()
    assert len(got) == 2 * len(rows) and found.where("false").count() == 0
    for r in got:
        s = source[r.refers_to]
        assert (r.page_id, r.target_uri, r.date, r.source_headers) == (s.page_id, s.target_uri, s.date, s.headers)
        assert r.source_payload_digest == sha1(s.payload.encode()) and r.block_digest == sha1(r.block.encode())
        assert r.content_length == len(r.block.encode()) and r.record_id != r.refers_to
        if r.record_type == "metadata":
            note = json.loads(r.block)
            assert note["Refers-To"] == s.record_id and note["HTTP-Headers"] == s.headers and note["Payload-Digest"] == r.source_payload_digest
        else:
            assert r.block == plain_text(s.payload)
    assert len({r.record_id for r in got}) == 6
    write_warc(found, str(tmp_path / "out"))
    back = read_warc(spark, str(tmp_path / "out")).collect()
    assert all(r.complete for r in back)
    assert sorted((r.headers["WARC-Record-ID"], r.block) for r in back) == sorted((r.record_id, r.block) for r in got)
    assert derivatives(responses(pages.where("false"))).count() == 0
