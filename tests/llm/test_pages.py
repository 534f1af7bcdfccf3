"""HTML layout and WARC revisits."""

import hashlib
import re

import pytest

from inkprint.llm import html_text, queries, warc


@pytest.mark.parametrize(("html", "text"), [
    ("<p>One<p>Two<br>three", "One\n\nTwo\nthree"),
    ("<div>a</div><div>b <b>c</b>\n d</div>", "a\nb c d"),
    ("<ul><li>a<li>b<ol start=3><li>x<li value=9>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  9. y\n- c"),
    ("<ol reversed><li>a<li hidden>no<li>b</ol>", "2. a\n1. b"),
    ("<table><tr><th>Name<th>N<tr><td>apple pie<td>10<tr><td colspan=2>over both columns", "Name       N\napple pie  10\nover both columns"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table>moved<tr><td>cell</table>", "moved\n\ncell"),
    ("<table><td>a<table><td>in<td>ner</table><td>b</table>", "a        b\n\nin  ner"),
    ("<title>t</title><style>.x{display:none}</style>a<span class=x>b</span><script>c</script>", "a"),
    ("<div style='visibility:hidden'>a<i style='visibility: visible'>b</i></div>", "b"),
    ("<pre>\n a\n  b</pre>", " a\n  b"),
    ("<details><summary>s</summary>no</details><details open>yes</details>", "s\nyes"),
    ("<select><option>a<option selected>b</select>", "b"),
    ("a</p>b", "a\n\nb"),
    ("x &amp; y &lt;z&gt; &nbsp;", "x & y <z> \xa0"),
    ("", ""), ("<p hidden>x", ""), ("<b>" * 5000 + "deep", "deep"),
])
def test_layout(html, text):
    assert html_text.render(html) == text


CSS = "<style>{}</style><p class=x>a<p>b".format
DEEP = "<div>" * 200


@pytest.mark.parametrize(("html", "text"), [
    (CSS("@media print { .x { display:none } }"), "a\n\nb"),
    (CSS("@media screen and (max-width: 600px) { .x { display:none } } .y{color:red}"), "a\n\nb"),
    (CSS("@media (min-width: 40em) { .x { display:none } }"), "b"),
    (CSS("@media print, (400px <= width < 2000px) { .x { display:none } }"), "b"),
    (CSS("@media not screen { .x { display:none } } @supports not (display:grid) { .x {display:none} }"), "a\n\nb"),
    (CSS("@supports (display:grid) { @media not print { .x {display:none} } }"), "b"),
    (CSS("@media print { .y {color:red} } .x { display:none"), "b"),
    (CSS(".x{display:none} .x{display:block}"), "a\n\nb"),
    (CSS(".x{display:block} .x{display:none}"), "b"),
    (CSS(".x{display:none} p{display:block}"), "b"),
    (CSS(".x{display:none} p.x{display:block}"), "a\n\nb"),
    (CSS(".x{display:none !important} .x{display:block}"), "b"),
    (CSS(".x{display:none; display:wrong}"), "b"),
    ("<style media=print>.x{display:none}</style><p class=x>a", "a"),
    ("<noscript><style>.x{display:none}</style></noscript><p class=x>a", "a"),
    ("<style>.x{display:none}</style><p class=x style='display:block'>a", "a"),
    ("<style>.x{visibility:hidden}</style><p class=x style='visibility:visible'>a", "a"),
    (DEEP + "a<script>no</script>b<span style='display:none'>no<i>no</i>no</span>c", "abc"),
    ("<style>.x{display:none}</style>" + DEEP + "a<div class=x>no<ul><li>no</ul>no</div>b", "ab"),
    ("<div>" * 148 + "<div hidden><div><div>no</div>no</div>no</div>b", "b"),
    (DEEP + "<b style='visibility:hidden'>no<i style='visibility:visible'>a</i>no</b>", "a"),
    ("<i><div>" * 30_000 + "<script>no</script>a" + "</div></i>" * 30_000 + "b", "a\nb"),
])
def test_only_visible_text(html, text):
    assert html_text.render(html) == text


def test_pages_without_html(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a", 1), (1, "u", "<p>a", 1), (2, None, None, None), (3, "w", "", 2),
                                   (4, "v", "<p>" + "long " * 50_000, 2)], "page_id bigint, url string, html string, text int")
    got = sorted(map(tuple, html_text.extract(pages, ["page_id", "text"], text_name="out").collect()), key=str)
    assert [(i, t[:9] if t else t) for i, _, t in got] == [(1, "a"), (1, "a"), (2, None), (3, ""), (4, "long long")]
    assert len(got[-1][2]) == 249_999 and html_text.extract(pages.limit(0), ["page_id"]).count() == 0


def record(kind, name, url, time, status="200 OK", headers=(), body=b""):
    block = f"HTTP/1.1 {status}\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers) + b"\r\n" + body
    head = (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\nWARC-Target-URI: {url}\r\nWARC-Date: {time}\r\n"
            f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n")
    return head.encode() + block + b"\r\n\r\n"


def test_revisits(spark):
    day = "2020-01-0{}T00:00:00Z".format
    rows = [
        record("response", "a1", "http://www.Site.org/p/?b=2&utm_x=1&a=1#f", day(1), headers=[("ETag", 'W/"1"'), ("X", "old"), ("Content-Length", "3")], body=b"one"),
        record("response", "a2", "https://site.org/p?a=1&b=2", day(3), headers=[("ETag", '"2"')], body=b"two"),
        record("response", "a3", "https://site.org/p?a=1&b=2", day(3), status="500 Oops", body=b"no"),
        record("revisit", "r1", "https://site.org:443/p?a=1&b=2", day(2), "304 Not Modified", [("ETag", '"1"'), ("X", "new"), ("Content-Length", "0")]),
        record("revisit", "r2", "https://site.org/p?a=1&b=2", day(3), "304 Not Modified", [("ETag", '"2"')]),
        record("revisit", "r3", "https://site.org/p?a=1&b=2", day(4), "304 Not Modified", [("ETag", '"2"')]),
        record("revisit", "r4", "https://other.org/", day(4), "304 Not Modified"),
        record("revisit", "r5", "nothing", day(4), "304 Not Modified"),
        record("response", "b", "https://late.org/", day(2), headers=[("Last-Modified", "x")], body=b"b"),
        record("revisit", "r6", "https://late.org", day(3), "304 Not Modified", [("Last-Modified", "y")]),
        record("revisit", "r7", "https://late.org", day(3), "304 Not Modified", [("Last-Modified", "x")]),
        b"junk", b"", None]
    table = spark.createDataFrame([(bytearray(r) if r is not None else None, 1) for r in rows], "record binary, url int")
    got = {r.record_id: r for r in warc.resolve(warc.parse(table), rows_per_bucket=2).collect()}
    assert {k: (r.refers_to, r.outcome) for k, r in got.items()} == {
        "r1": ("a1", "resolved"), "r2": ("a1", "tag_differs"), "r3": ("a2", "resolved"), "r4": (None, "no_response"),
        "r5": (None, "no_url"), "r6": ("b", "date_differs"), "r7": ("b", "resolved")}
    assert got["r1"].headers == {"etag": '"1"', "x": "new", "content-length": "3"} and bytes(got["r1"].body) == b"one"
    assert got["r2"].headers is None and got["r2"].body is None
    assert warc.resolve(warc.parse(table.limit(0))).count() == 0


def test_revisits_query_reads_the_joined_body(spark, monkeypatch):
    rows = [record("response", "page:1", "https://a.org/", "2020-01-01T00:00:00Z", headers=[("ETag", "x"), ("Content-Length", "9")], body=b"one"),
            record("response", "page:2", "https://b.org/", "2020-01-01T00:00:00Z"),
            *[record("revisit", f"again:{i}", f"https://{s}.org/", "2020-01-02T00:00:00Z", "304 Not Modified") for i, s in enumerate("abc", 1)]]
    table = spark.createDataFrame([(bytearray(r),) for r in rows], "record binary")
    monkeypatch.setattr(queries, "page_records", lambda *_: table)
    got = {r.page_id: (r.content_length, r.digest) for r in queries.op7_warc_revisits(spark, "none").collect()}
    assert got == {1: (3, "md5:" + hashlib.md5(b"one").hexdigest()), 2: (0, "md5:" + hashlib.md5(b"").hexdigest()), 3: (None, None)}


def test_malformed_dates_and_lengths(spark):
    good = record("response", "a", "https://site.org/p", "2020-01-01T00:00:00Z", headers=[("ETag", '"1"')], body=b"one")
    late = record("response", "b", "https://site.org/p", "2020-13-45T99:00:00Z", headers=[("ETag", '"1"')], body=b"two")
    odd = record("revisit", "r1", "https://site.org/p", "not a date", "304 Not Modified", [("ETag", '"1"')])
    fine = record("revisit", "r2", "https://site.org/p", "2020-01-02T00:00:00Z", "304 Not Modified", [("ETag", '"1"')])
    fine = re.sub(rb"(\r\nContent-Length: )\d+", lambda m: m[1] + "²".encode(), fine, count=1)
    table = spark.createDataFrame([(bytearray(r),) for r in (good, late, odd, fine)], "record binary")
    got = {r.record_id: (r.outcome, r.refers_to) for r in warc.resolve(warc.parse(table)).collect()}
    assert got == {"r1": ("no_response", None), "r2": ("resolved", "a")}


@pytest.mark.parametrize("hot", [100, 1000])  # one response above the bound, none above it
def test_one_url_with_most_revisits(spark, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT_REVISITS", hot)
    day = "2020-01-{:02d}T00:00:00Z".format
    rows = [record("response", f"a{i}", "https://hot.org/p", day(i), headers=[("ETag", '"1"')], body=b"%d" % i) for i in (1, 9, 20)] * 2
    rows += [record("revisit", f"r{i}", "https://hot.org/p", day(2 + i % 27), "304 Not Modified", [("ETag", '"1"')]) for i in range(300)]
    rows += [record("revisit", f"s{i}", f"https://cold.org/{i}", day(3), "304 Not Modified") for i in range(40)]
    table = spark.createDataFrame([(bytearray(r),) for r in rows], "record binary")
    got = {r.record_id: r for r in warc.resolve(warc.parse(table), rows_per_bucket=5).collect()}
    assert len(got) == 340 and all(got[f"s{i}"].outcome == "no_response" for i in range(40))
    for i in range(300):
        at = 2 + i % 27
        want = max(d for d in (1, 9, 20) if d < at)
        assert got[f"r{i}"].refers_to == f"a{want}" and bytes(got[f"r{i}"].body) == b"%d" % want
