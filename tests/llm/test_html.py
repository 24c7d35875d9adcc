"""The line-block distribution on pages that mark no article, inside articles, and on hostile pages."""

import time

import pytest

from quarrystone.llm import html, warc

LONG = ("A sentence of the article that is long enough to make a window surge by itself, " * 2).strip()


def page(*parts):
    return "<html><head><title>T</title></head><body>" + "".join(parts) + "</body></html>"


MENU = "<div>" + "".join(f"<div><a href='/{x}'>{x}</a></div>" for x in ("Home", "News", "About", "Contact")) + "</div>"
TEASERS = "<div>" + "".join(f"<p><a href='/{x}'>A headline that is a link to something else, number {x}, and long</a></p>" for x in range(5)) + "</div>"


def test_text_stands_between_surge_and_dive():
    body = f"<div><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG} end</p><p>The end.</p></div>"
    got = html.extract_text(page("<div>The Site</div>", MENU, body, TEASERS, "<div>Some town, 2020</div>"))
    assert got == f"Title\n{LONG}\nShort.\n{LONG} end\nThe end."


def test_without_surge_and_dive_the_rest_would_stay(monkeypatch):
    body = page(MENU, f"<div><p>{LONG}</p><p>x</p></div>", TEASERS)
    want = html.extract_text(body)
    monkeypatch.setattr(html, "surge_and_dive", lambda *_: None)
    assert html.extract_text(body) != want == f"{LONG}\nx"


def test_a_page_without_containers_is_cut_at_the_windows():
    flat = page("<p>Site</p><p>Far away</p><p>Before it</p><p>Short intro.</p><p>By someone</p>", f"<p>{LONG}</p>", TEASERS[5:-6], f"<p>{LONG}</p><p>After it</p>")
    assert html.extract_text(flat) == f"Short intro.\nBy someone\n{LONG}\n{LONG}\nAfter it"


def test_sections_after_a_list_of_links_stay():
    second = "A second section, which is shorter, but over the height of a surge in characters, so it is text."
    got = html.extract_text(page(f"<section><p>{LONG}</p></section>", "<ul>" + "<li><a href='/'>link</a>" * 4 + "</ul>", f"<section><p>Short intro.</p><p>{second}</p></section>"))
    assert got == f"{LONG}\nShort intro.\n{second}"


@pytest.mark.parametrize("name", ["related-work", "search", "share", "promo", "social-history", "alert", "widget", "response", "with-sidebar", "headers", "commentary", "noticeable"])
def test_names_in_an_article_drop_no_paragraphs(name):
    assert html.extract_text(page(f"<article><p>One</p><div class='{name}'><p>Two</p></div><p>Three</p></article>")) == "One\nTwo\nThree"


@pytest.mark.parametrize("name", ["ad", "ad-box", "advert", "cookie-notice", "comments", "comment-list", "commentList", "sidebar", "left-sidebar", "nav", "main-menu", "notice", "ad_300x250", "reader-comments", "article-comments", "comment-form", "privacy-notice", "story-ad", "post-navigation"])
def test_boilerplate_in_an_article_goes(name):
    assert html.extract_text(page(f"<article><p>One</p><div class='{name}'><p>Two</p></div><p>Three</p></article>")) == "One\nThree"


def test_names_of_wrappers_do_not_drop_a_page():
    got = html.extract_text(page(f"<div class='content with-sidebar has-comments'><div class='post-header'><h1>Title</h1></div><p>{LONG}</p></div><div class='site-footer'>foot</div><div id='comments'><p>{LONG}</p></div>"))
    assert got == f"Title\n{LONG}"


def test_quotes_and_open_tags():
    assert html.extract_text('<p title="a > b">x</p><p title=it\'s>y</p><p title="open>z</p>') == "x\ny\nz"
    assert html.extract_text("<p>a < b, c <d") == "a < b, c <d"
    assert html.extract_text("<article><p>a<!-- b <p>c --><p>d<script>e</p></script>f<title>g</title></article>") == "a\ndf"


N = 250_000
HOSTILE = {
    "open and other ends": "<b>" * (N // 2) + "</i>" * (N // 2), "unclosed tags": "<a " * N, "quotes": "<a x=\"" * N, "one bracket far away": '<a x="y>" ' * (N // 2), "nested": "<div>" * N, "ends": "</div>" * N,
    "comments": "<!-" * N, "titles": "<title>" * N, "names": "<" + "a" * (4 * N), "attribute": "<p " + "a" * (4 * N) + ">x", "spaces": "<p a" + " " * (4 * N) + "=>x", "widgets": "<article>" + "<div class=share>" * (N // 4) + "<p>x",
    "asides": "<aside>" * (N // 2) + "<article>x", "paragraphs": "<p>x" * N, "links": "<a href=x>y" * (N // 2), "references": "&amp" * N, "spans in names": "<p class='" + "a-" * (2 * N) + "'>x", "less": "<" * 4 * N,
}


@pytest.mark.parametrize("kind", sorted(HOSTILE))
def test_hostile_pages_take_seconds(kind):
    """About a megabyte each."""
    began = time.process_time()
    html.extract_text(HOSTILE[kind])
    source = warc.response("1", "http://x.org/", HOSTILE[kind])
    assert len(warc.derive(source["headers"], source["block"])) == 2
    assert time.process_time() - began < 20


def records():
    return [warc.response(str(i), f"http://x.org/{i}", f"<title>{i}</title><p>text {i}" + "x" * 500 * i) for i in range(5)]


@pytest.mark.parametrize("packed", [True, False])
def test_damaged_records_are_skipped_and_reported(packed):
    import gzip

    whole = [warc.serialise(r["headers"], r["block"]) for r in records()]
    pack = gzip.compress if packed else lambda x: x
    ids = lambda data: [(h.get("WARC-Record-ID"), e) for h, _, e in warc.read(data)]
    names = [r["headers"]["WARC-Record-ID"] for r in records()]
    assert ids(b"".join(map(pack, whole))) == [(n, None) for n in names]
    bad = [whole[0], whole[1].replace(b"Content-Length: ", b"Content-Length: many "), whole[2], whole[3][:300], whole[4]]
    assert ids(b"".join(map(pack, bad)))[:3] == [(names[0], None), (names[1], "the length is no number"), (names[2], None)]
    assert (names[0], None) in ids(b"".join(map(pack, bad))) and ids(b"".join(map(pack, bad)))[3][1] in ("headers do not end", "the block is cut off")
    assert ids(pack(whole[0]) + pack(whole[1])[:-40])[0] == (names[0], None)
    assert ids(b"") == [] and ids(b"no WARC here") == [] and ids(b"WARC/1.0")[0][1] == "headers do not end"
    if packed:
        broken = bytearray(pack(whole[1]))
        broken[60:70] = b"\0" * 10
        assert [n for n, e in ids(pack(whole[0]) + bytes(broken) + pack(whole[2])) if e is None][:1] == [names[0]]
        assert (names[2], None) in ids(pack(whole[0]) + bytes(broken) + pack(whole[2]))


def test_records_with_nulls_are_written(spark):
    rows = spark.createDataFrame([("a", None, None), ("b", {"WARC-Type": "metadata"}, bytearray(b"x"))], "record_id string, headers map<string,string>, block binary")
    assert warc.to_warc(rows).count() == 2


def plain_records(pages):
    """Records of pages without markup that is open, in another way than the operator reads them."""
    import base64
    import hashlib
    import re

    out = {}
    for key, url, page in pages:
        digest = "sha1:" + base64.b32encode(hashlib.sha1((page or "").encode()).digest()).decode()
        links = re.findall(r'<a href="([^"]*)">', page or "")
        out[key] = (url, digest, links, re.findall(r"<title>(.*?)</title>", page or ""))
    return out


def test_op10_against_plain_records(spark, sf_dir):
    from html import unescape

    from quarrystone.llm import registry

    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    want = plain_records(pages)
    rows = registry.queries()["op10_warc"](spark, sf_dir).collect()
    assert len(rows) == 2 * len(pages)
    for r in rows:
        url, digest, links, titles = want[r["page_id"]]
        assert r["target_uri"] == url and r["source_payload_digest"] == digest and r["content_length"] == len(r["block"].encode())
        if r["warc_type"] == "metadata":
            fields = [line.partition(": ")[::2] for line in r["block"].split("\r\n")]
            assert [v for k, v in fields if k == "outlink"] == [" ".join(unescape(x).split()) for x in links]
            assert [v for k, v in fields if k == "title"] == [" ".join(unescape(x).split()) for x in titles]
            assert dict(fields)["source-payload-digest"] == digest and dict(fields)["source-record-id"] == r["refers_to"]
        else:
            assert "<script" not in r["block"] and "<p>" not in r["block"]
