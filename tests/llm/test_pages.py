import collections
import hashlib
import io
import random
import re
import zipfile

import pytest

from vistalog.llm import pagetext as P
from vistalog.llm import zip_warc as Z
from vistalog.llm.queries import queries

CASES = [
    ("<html><body><nav><p>menu</nav><article><h1>T&eacute;st</h1><p>One  <b>two\n</b> <br>three &amp; four<p>five</article><footer>f</footer>", "Tést\nOne two three & four\nfive"),
    ("<body><header><h1>Site</h1></header><div class='cookie-notice'>We use cookies</div><main><h1>A</h1><p>b<form><p>mail</form><div id=comments><p>nice</div><ul><li>x<li>y</ul></main><aside>z</aside>", "A\nb\nx\ny"),
    ("<div id='header'>Site</div><div id='content'><h1>T</h1><p>Long text here is the text</p><p>and more</p><div class='ads'>ad</div></div><div class='sidebar'>s</div>", "T\nLong text here is the text\nand more"),
    ("<article><p>a</p><script>if (x<b) '</p>'</script><style>p{}</style><!-- <p>c --><p>d &#233; &lt;tag&gt;</article>", "a\nd é <tag>"),
    ("<article><p>cut off <b>here", "cut off here"),
    ("<article><header><h1>In</h1></header><table><tr><td>a<td>b</table><article class='comment'><p>reader</article></article>", "In\na\nb"),
    ("plain words", "plain words"),
    ("<article><p>1 < 2 and 3 > 2</article>", "1 < 2 and 3 > 2"),
    ("", ""),
]


@pytest.mark.parametrize("source, want", CASES)
def test_single_pages(source, want):
    assert (P.Page(source).text(None) if source else "") == want


def test_template_strings_and_hosts(spark):
    page = lambda i: f"<html><body><div class=top><p>Welcome to the site</p></div><div class=main2><h2>Title {i}</h2><p>{'text ' * 30}{i}</p><p>Read our rules</p></div><div class=bottom><p>{i} visitors</p></div></body></html>"
    rows = [(i, f"https://a.example.com/{i}", page(i)) for i in range(12)] + [(100, None, page(5)), (101, "https://b.example.org", None), (102, "no url", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "'y' as host", "1 as root")
    got = {r["page_id"]: r["text"] for r in P.extract(df).collect()}
    assert len(got) == 15 and got[101] == got[102] == ""
    assert got[3] == f"Title 3\n{('text ' * 30) + '3'}\nRead our rules"
    assert "Read our rules" in got[100]
    assert P.extract(df.limit(0)).collect() == []


def test_host_of():
    assert P.host_of("HTTPS://user@Www.Example.com:80/x") == "www.example.com" and P.host_of("//a/b") == "a" and P.host_of("x") is None and P.host_of(None) is None


def test_package_is_a_zip_and_records_are_found_by_ranges():
    out = io.BytesIO()
    package = Z.Package(out)
    body = {i: (f"page {i} " * (i + 1)).encode() for i in range(50)}
    for i, b in body.items():
        package.add(f"https://x/{i}", "d", Z.record(i, f"https://x/{i}", b, hashlib.sha256(b).hexdigest(), None))
    package.close()
    raw, reads = out.getvalue(), []

    def read(at, n):
        reads.append(n)
        return raw[at : at + n]

    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and sorted(z.namelist()) == sorted([Z.DATA, Z.INDEX])
    got = {}
    for _, _, data in Z.records_in(read, len(raw)):
        fields, block = Z.parse_record(data)
        got[int(fields["x-page-id"])] = block.partition(b"\r\n\r\n")[2]
    assert got == body
    with pytest.raises(ValueError):
        Z.directory(lambda a, n: raw[:-30][a : a + n], len(raw) - 30)
    with pytest.raises(ValueError):
        Z.parse_record(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc")


def test_zip64_directories_are_read():
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("a", b"hello")
    raw = plain.getvalue()
    end = raw.rindex(b"PK\x05\x06")
    start, size = int.from_bytes(raw[end + 16 : end + 20], "little"), int.from_bytes(raw[end + 12 : end + 16], "little")
    wide = b"PK\x06\x06" + (44).to_bytes(8, "little") + b"\x2d\0\x2d\0" + b"\0" * 8 + (1).to_bytes(8, "little") * 2 + size.to_bytes(8, "little") + start.to_bytes(8, "little")
    locator = b"PK\x06\x07" + b"\0" * 4 + end.to_bytes(8, "little") + (1).to_bytes(4, "little")
    tail = raw[end : end + 8] + b"\xff" * 12 + raw[end + 20 :]
    new = raw[:end] + wide + locator + tail
    method, at, n = Z.directory(lambda a, k: new[a : a + k], len(new))["a"]
    assert method == 0 and new[at : at + n] == b"hello"


def test_responses_and_revisits(spark):
    long, short = "x" * 100, "y" * 99
    rows = [(5, "u5", long), (3, "u3", long), (9, None, long), (7, "u7", short), (8, "u8", short), (None, "u", long), (4, "u4", None), (3, "u3", long), (None, "n1", "z" * 200), (None, "n2", "z" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as first", "2 as copies", "'p' as payload")
    got = sorted(((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in Z.round_trip(df).collect()), key=str)
    want = [
        (3, "u3", "response", None, 100), (3, "u3", "response", None, 100), (4, "u4", "response", None, 0), (5, "u5", "revisit", 3, 100), (7, "u7", "response", None, 99), (8, "u8", "response", None, 99),
        (9, None, "revisit", 3, 100), (None, "n1", "response", None, 200), (None, "n2", "response", None, 200), (None, "u", "revisit", 3, 100),
    ]
    assert got == sorted(want, key=str)
    assert Z.round_trip(df.limit(0)).collect() == []


def test_every_numbered_query_is_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in queries()}) == list(range(1, 14))


def stripped(source):
    """A page without names and without any element that tells its role."""
    return re.sub(r"<div[^>]*>", "<div>", re.sub(r"<(/?)(?:nav|article|footer|header|aside|main|section)\b[^>]*>", r"<\1div>", source))


def test_templates_are_right_without_tags_and_names(spark):
    """Of pages that only div, headings, lists and paragraphs make up, the template finds what tags and names tell; some it alone finds."""
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    bare = [(i, u, stripped(h)) for i, u, h in rows]
    schema = "page_id long, url string, html string"
    want = {r["page_id"]: r["text"] for r in P.extract(spark.createDataFrame(rows, schema)).collect()}
    got = {r["page_id"]: r["text"] for r in P.extract(spark.createDataFrame(bare, schema)).collect()}
    alone = {i: P.Page(h).text(None) for i, _, h in bare}
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
    assert sum(got[i] == want[i] != alone[i] for i in want) > sum(alone[i] == want[i] != got[i] for i in want)


def test_templates_equal_plain_deduction(spark):
    """Occurrence vectors kept whole, host by host, give the same templates as their sums."""
    rnd = random.Random(5)
    page = lambda h, i: f"<body><div class=top{h}><ul><li>home<li>about</ul></div><div class=c{h}><h1>Title {i}</h1>{''.join('<p>' + ' '.join(rnd.choices(['ab', 'cde', 'fghi'], k=12)) + '</p>' for _ in range(rnd.randint(1, 5)))}<p>All rights are ours</p>{'<div class=related><p>see also</p></div>' if i % 3 else ''}</div><div class=low><p>{i} readers</p></div></body>"
    rows = [(100 * h + i, f"http://h{h}.org/{i}", page(h, i)) for h in range(4) for i in range(2 + 3 * h)] + [(900, "http://h3.org/x", page(3, 1))]
    rows.append((901, "http://h3.org/y", rows[-1][2]))
    hosts = {}
    for _, url, source in rows:
        hosts.setdefault(P.host_of(url), {})[source] = P.Page(source)
    templates = {}
    for host, pages in hosts.items():
        vectors, about = {}, {}
        for source, p in pages.items():
            named = {e[0] for e in p.elements[1:] if e[4] & P.NAME and not p.elements[e[1]][4] & P.NAME}
            for path, (n, rank, depth, chars) in p.masses(P.TAG).items():
                vectors.setdefault((path, False), {})[source] = n
                old = about.setdefault((path, False), [rank, depth, 0, False])
                about[path, False] = [max(rank, old[0]), max(depth, old[1]), old[2] + chars, old[3] or path in named]
            for i, t in p.blocks:
                if not p.elements[i][4] & P.TAG:
                    v = vectors.setdefault((P.string_token(p.elements[i][0], t), True), {})
                    v[source] = v.get(source, 0) + 1
        classes = collections.Counter(tuple(sorted(v.items())) for v in vectors.values())
        valid = [k for k, v in vectors.items() if classes[tuple(sorted(v.items()))] > 1 and 2 * len(v) >= len(pages)]
        if len(pages) < 3:
            continue
        total = about[0, False][2]
        once = [(about[k][0], about[k][1], -k[0]) for k in valid if not k[1] and about[k][0] >= 0 and 0 < about[k][2] and 2 * about[k][2] >= total and sum(vectors[k].values()) == len(vectors[k])]
        repeated = frozenset(k[0] for k in valid if k[1] and len(vectors[k]) >= 0.9 * len(pages))
        templates[host] = (-max(once)[2], frozenset(k[0] for k in valid if not k[1] and about[k][3]), repeated)
    want = {i: P.Page(h).text(*templates.get(P.host_of(u), (None,))) for i, u, h in rows}
    got = {r["page_id"]: r["text"] for r in P.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want and len(templates) == 3
    assert all("All rights" in got[i] and "see also" not in got[i] and got[i].startswith("Title") for i in got if i // 100 == 3)
    assert got[900] == got[901]


@pytest.mark.parametrize("n", [4, 5, 50])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_headings_and_lines_that_all_articles_have_stay(spark, n, tag):
    """What repeats among text that differs is the article's; a container that is the same on all pages is the template's."""
    body = lambda i: f"<{tag}><h1>Story {i}</h1><h2>Introduction</h2><p>First of {i} words.</p><div><p>Subscribe now</p><h3>Terms</h3></div><h2>Conclusion</h2><p>Last of {i} words.</p><p>The end</p></{tag}>"
    rows = [(i, f"http://h.org/{i}", f"<body><div><ul><li>home<li>about</ul></div>{body(i)}<div><p>imprint</p></div></body>") for i in range(n)]
    got = {r["page_id"]: r["text"].split("\n") for r in P.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == [f"Story {i}", "Introduction", f"First of {i} words.", "Conclusion", f"Last of {i} words.", "The end"] for i in range(n))


def test_long_pages(spark):
    body = "".join(f"<p>paragraph {i} of a long page</p>" for i in range(40_000))
    df = spark.createDataFrame([(1, "http://a/1", f"<article>{body}</article>"), (2, "http://a/2", "<p>" * 20_000 + "x")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in P.extract(df).collect()}
    assert got[1].count("\n") == 39_999 and got[2] == "x"
    assert {r["page_id"]: r["payload_bytes"] for r in Z.round_trip(df).collect()} == {1: len(f"<article>{body}</article>"), 2: 60_001}
