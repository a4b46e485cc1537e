import subprocess
import sys
from html.parser import HTMLParser
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from parcelweave.functions import urls
from parcelweave.operators import html as html_operator
from parcelweave.operators import pages as P
from parcelweave.operators.html import shred, shred_html
from parcelweave.operators.selectors import Page, UnsupportedSelector, extract, extract_all, select, xpath_to_css

HTML = """<html><head><title> Record </title><style>.x{background:url('//cdn.a/bg.png')} .logo{background:url(logo.png)}</style>
<script>var a = "</p><b>";</script></head><body>
<div id="lot">77-0420-9</div><div id="holder"> Ada <i>Lovelace</i> </div><div class="address big">8 Mill Lane</div>
<a href="https://example.com/owner/1" class="own">O</a><a href="/local">L</a><a>none</a>
<table class="pair-grid"><tr><td id="lot_plotNo">R-1<tr><td id="lot_second">two</table>
<table id="lot_amounts"><tr class="sum-row"><td class="amount">1</td></tr>
<tr class="sum-row"><td class="amount">2</td></tr>
<tr class="sum-row"><th>t</th><td class="amount">30</td><td class="amount">31</td></tr></table>
<p>one<p>two <b>bold<p>three</p>
<img src="//cdn.a/house.jpg?w=1" srcset="/a.png 1x, //b.c/d.webp 2x, data:zzz 3x"><img src="/icon.png"><img src="data:image/png;x">
<div style="background-image: url('/bg2.GIF')"></div><img src="/page.html"><img src="/a.png" data-zoom="/z.jpeg">
</body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    df = spark.createDataFrame([(1, HTML), (2, ""), (3, None)], "page_id int, html string")
    return shred_html(df, keep=["page_id"]).where("page_id = 1").cache()


def one(page, column):
    return page.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ({"selector": "#lot"}, "77-0420-9"),
        ({"selector": "#holder"}, "AdaLovelace"),
        ({"selector": "div.address.big"}, "8 Mill Lane"),
        ({"selector": "a", "attr": "href"}, "https://example.com/owner/1"),
        ({"selector": "a", "attr": "href", "index": 2}, ""),
        ({"selector": "a", "index": -1}, "none"),
        ({"selector": "a", "index": 9}, None),
        ({"selector": "a", "index": -9}, None),
        ({"selector": "[id*='_plotNo']"}, "R-1"),
        ({"selector": "[id^=lot_][id$=second]"}, "two"),
        ({"selector": "td + td"}, "31"),
        ({"selector": "table > tr > td"}, "R-1"),
        ({"selector": "body table tr td.amount", "index": 1}, "2"),
        ({"selector": "h9, th , #nope"}, "t"),
        ({"selector": "div:contains('Mill')"}, "8 Mill Lane"),
        ({"selector": "title"}, "Record"),
        ({"selector": "p", "index": 1}, "twobold"),
        ({"selector": "p", "index": 2}, "three"),
        ({"selector": "td:nth-child(2)"}, "30"),
        ({"selector": "p ~ p"}, "twobold"),
        ({"selector": "p ~ p", "index": 1}, "three"),
        ({"selector": "div:not(.address):not(#lot)", "index": 0}, "AdaLovelace"),
        ({"selector": "td:last-of-type", "index": -1}, "31"),
        ({"selector": "tr:nth-child(2n+1) > .amount", "index": 1}, "30"),
        ({"selector": "tr:nth-last-child(-n+1) td"}, "two"),
        ({"selector": "p:first-of-type"}, "one"),
        ({"selector": "p:only-child"}, None),
        ({"selector": "p:nonsense"}, None),
        ({"selector": "p >> a"}, None),
        ({"selector": r"(?P<a_id>id)=\"(?P<b>lot)\"", "type": "regex"}, "id"),
        ({"selector": "i", "attr": "html"}, "<i>Lovelace</i>"),
        ({"selector": "img[data-zoom]", "attr": "data-zoom"}, "/z.jpeg"),
        ({"selector": '//div[@id="holder"]', "type": "xpath"}, "AdaLovelace"),
        ({"selector": '//div[@class="address"]', "type": "xpath"}, "8 Mill Lane"),
        ({"selector": "//table/tr/th", "type": "xpath"}, "R-1two"),
        ({"selector": r"LOT\">([\d-]+)<", "type": "regex"}, "77-0420-9"),
        ({"selector": ""}, None),
    ],
)
def test_selectors(page, selector, want):
    assert one(page, extract(Page.columns(), selector)) == want


def test_xpath_forms():
    assert xpath_to_css("//span") == "span"
    assert xpath_to_css("nothing") is None


def test_extract_all_and_links(page):
    hrefs = one(page, extract_all(Page.columns(), {"selector": "a", "attr": "href"}))
    assert hrefs == ["https://example.com/owner/1", "/local", ""]
    links = one(page, P.discover_links(Page.columns(), {"owner_links": {"selector": "a"}, "x": {}}))
    assert [tuple(x) for x in links] == [("https://example.com/owner/1", "owner", 5)]


def test_images(page):
    found = one(page, P.extract_images(Page.columns(), {"selector": "img[data-zoom]", "attr": "data-zoom"}))
    assert found == ["/z.jpeg", "https://cdn.a/house.jpg?w=1", "/a.png", "https://b.c/d.webp", "/bg2.GIF", "https://cdn.a/bg.png"]


def test_table_extract(page):
    value = P.table_extract(Page.columns(), "#lot_amounts .sum-row", ".amount", 2)
    assert one(page, value) == "30"
    assert one(page, P.table_extract(Page.columns(), "#lot_amounts tr", ".amount", 7)) is None


def test_shred_positions():
    nodes, text = shred("<div>a<!-- c -->b<p>c<b>d<p>e</div>f")
    by_tag = [(n["tag"], n["parent"], text[n["text_from"] : n["text_to"]]) for n in nodes]
    assert by_tag == [("div", 0, "abcde"), ("p", 1, "cd"), ("b", 2, "d"), ("p", 1, "e")]
    assert shred(None) == ([], "")


@pytest.mark.parametrize("depth", [300, 5000])
def test_any_depth_keeps_text_source_and_parents(depth):
    html = "<div>" * depth + "<p>DEEP TEXT</p>" + "</div>" * depth + "<b>after</b>"
    nodes, text = shred(html)
    assert len(nodes) == depth + 2 and [n["parent"] for n in nodes] == [*range(depth + 1), 0]
    deep = nodes[depth]
    assert text[deep["text_from"] : deep["text_to"]] == "DEEP TEXT"
    assert html[deep["html_from"] : deep["html_to"]] == "<p>DEEP TEXT</p>"
    assert all(n["post"] == depth + 1 for n in nodes[: depth + 1]) and nodes[-1]["post"] == depth + 2
    outer = nodes[0]
    assert html[outer["html_from"] : outer["html_to"]] == html[: -len("<b>after</b>")]
    # A fixed number of values an element, whatever the depth.
    assert {len(n) for n in nodes} == {16}


def test_many_open_elements_stay_cheap():
    nodes, _ = shred("<i>" * 20_000 + "<p>x" * 2_000)
    assert len(nodes) == 22_000


def test_places_among_siblings():
    nodes, _ = shred("<ul><li>a<li>b<p>c</ul><ul></ul>")
    got = [(n["tag"], n["nth"], n["siblings"], n["nth_of_type"], n["siblings_of_type"]) for n in nodes]
    assert got == [("ul", 1, 2, 1, 2), ("li", 1, 2, 1, 2), ("li", 2, 2, 2, 2), ("p", 1, 1, 1, 1), ("ul", 2, 2, 2, 2)]


def test_valid_but_unsupported_selectors_are_refused():
    for css in ("p:hover", "a:is(b)", "p:not(a b)", "p:nth-child(2 of .x)"):
        with pytest.raises(UnsupportedSelector):
            extract(Page.columns(), {"selector": css})


def test_patterns_java_cannot_compile_are_refused(spark):
    with pytest.raises(ValueError, match="cannot be used"):
        extract(Page.columns(), {"selector": r"a(b)?(?(1)c|d)", "type": "regex"})


def test_block_types(spark):
    cases = {
        "Checking your BROWSER": (True, None), "cloudflare captcha": (True, "cloudflare"), "CAPTCHA": (True, "captcha"),
        "access denied ddos protection": (True, "access_denied"), "ddos protection": (True, "ddos_protection"),
        "robot check": (True, None), "fine": (False, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "html string")
    got = df.select("html", P.is_blocked(F.col("html")), P.block_type(F.col("html"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == cases


def test_record_id_and_urls(spark):
    df = spark.createDataFrame([("", "", "abc", "ab1234"), (None, "A9", "x", "y"), (None, None, "abc", "short")], "parcel_id string, apn string, a string, b string")
    got = [r[0] for r in df.select(P.resolve_record_id(df.columns, ["a", "b"])).collect()]
    assert got == ["ab1234", "A9", "unknown"]
    links = spark.range(1).select(
        urls.map_links(F.lit(33.448377), F.lit(-112.0), F.lit("1 Main St, X")).alias("m"),
        urls.map_links(F.lit(0.0), F.lit(1.0)).alias("zero"),
        urls.id_from_url(F.lit("http://a/?KeyValue=1&KeyValue=R 2")).alias("k"),
        urls.id_from_url(F.lit("http://a/")).alias("whole"),
    ).first()
    assert links["m"]["google_maps"] == "https://www.google.com/maps?q=33.448377,-112.0"
    assert links["m"]["google_maps_address"] == "https://www.google.com/maps/search/1+Main+St+X"
    assert (links["zero"], links["k"], links["whole"]) == (None, "R 2", "http://a/")


def test_parse_pages_reports_errors_and_keeps_records(spark):
    df = spark.createDataFrame([(1, HTML), (2, "<p>x")], "page_id int, html string")
    config = {
        "selectors": {"parcel_id": {"selector": "#lot"}, "owner": {"selector": "#holder"}},
        "mapping": {
            "fields": {
                "parcel_id": {"source": "parcel_id", "transform": "clean_parcel_id"},
                "owner_name": {"source": "owner", "transform": "normalize_name"},
                "lat": {"const": "33.5"},
                "lon": {"const": "-112.25"},
            },
            "required": ["owner_name"],
        },
        "discovery": {"parcel_links": {"selector": "a.own"}},
    }
    got = {r["page_id"]: r for r in P.parse_pages(df, config).collect()}
    assert got[1]["parcel_id"] == "77-0420-9" and got[1]["errors"] == []
    assert got[1]["links"][0]["relationship_type"] == "parcel"
    assert got[1]["external_links"]["apple_maps"] == "https://maps.apple.com/?ll=33.5,-112.25"
    # No id field holds a value, so the first field that looks like an id is taken.
    assert got[2]["parcel_id"] == "-112.25" and got[2]["errors"] == ["Missing required field: owner_name"]


def test_the_tokeniser_travels_without_the_package(tmp_path):
    """Workers of a session started elsewhere cannot import this package."""
    script = tmp_path / "job.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})\n"
        "from pyspark.sql import SparkSession\n"
        "from parcelweave.operators.html import shred_html\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "df = spark.createDataFrame([(1, '<p>x')], 'page_id int, html string')\n"
        "print('TEXT', shred_html(df, keep=['page_id']).first()['page_text'])\n"
    )
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "TEXT x" in done.stdout, done.stderr[-2000:]


def random_page(seed, size):
    import random

    pick, out, opened = random.Random(seed), [], []
    while len(out) < size:
        if opened and pick.random() < 0.45:
            out.append(f"</{opened.pop()}>")
        else:
            opened.append(pick.choice(["div", "span", "section", "b"]))
            out.append(f'<{opened[-1]} class="k{pick.randint(0, 2)}">')
    return "".join(out + [f"</{tag}>" for tag in reversed(opened)])


def related(nodes, css):
    """Places that match, by comparing every element with every earlier match."""
    near = {
        " ": lambda e, n: e["pre"] < n["pre"] <= e["post"],
        ">": lambda e, n: e["pre"] == n["parent"],
        "+": lambda e, n: e["pre"] == n["prev"],
        "~": lambda e, n: e["parent"] == n["parent"] and e["pre"] < n["pre"],
    }

    def fits(n, simple):
        tag, _, kind = simple.partition(".")
        return tag in ("", "*", n["tag"]) and (not kind or kind in n["classes"])

    found = set()
    for option in css.split(","):
        relation, earlier = None, []
        for part in option.split():
            if part in near:
                relation = part
                continue
            matched = [n for n in nodes if fits(n, part) and (relation is None or any(near[relation](e, n) for e in earlier))]
            relation, earlier = " ", matched
        found |= {n["pre"] for n in earlier}
    return sorted(found)


def test_relations_by_comparing_all_pairs(spark):
    pages = [(i, "u", random_page(i, size)) for i, size in enumerate([0, 1, 30, 300, 900])] + [(9, "u", "<div>" * 150 + "<b>deep</b>")]
    shredded = shred_html(spark.createDataFrame(pages, "page_id long, url string, html string"))
    chosen = ["div b", "div > b", "* + b", "div ~ b", "div.k1 span ~ b", ".k0 .k1 > .k2", "section b , div + div span , b", "div div div div b", "span ~ span ~ span"]
    columns = [F.transform(select(Page.columns(), css), lambda n: n["pre"]).alias(f"c{i}") for i, css in enumerate(chosen)]
    for row in shredded.select("page_id", "nodes", *columns).collect():
        for i, css in enumerate(chosen):
            assert row[f"c{i}"] == related(row["nodes"], css), (row["page_id"], css)


def test_plain_tags_skip_the_standard_parser(monkeypatch):
    read, parse = [], HTMLParser.parse_starttag
    monkeypatch.setattr(HTMLParser, "parse_starttag", lambda self, i: read.append(i) or parse(self, i))
    nodes, text = shred('<div class="wrap">' * 300 + "<p>x<b id=y>z</b>" + "</div>" * 300)
    # Only the unquoted attribute needs it; every tag went through it before.
    assert (len(nodes), text, len(read)) == (302, "xz", 1)


def test_ancestors_are_found_without_rounds(spark):
    assert "aggregate" in repr(select(Page.columns(), "h1 ~ b"))
    assert "aggregate" not in repr(select(Page.columns(), "div.wrap div.wrap nav > ul li a"))
    # 130 elements before, so that ends are looked up across blocks and inside one.
    html = "<i></i>" * 60 + "<u><b>1</b>" + "<i></i>" * 70 + "<b>2</b></u><b>3</b><u></u><b>4</b><u><b>5</b></u>"
    shredded = shred_html(spark.createDataFrame([(1, "u", html), (2, "u", None), (3, "u", "<b>")], "page_id int, url string, html string"))
    rows = shredded.select("page_id", F.transform(select(Page.columns(), "u b"), lambda n: Page.columns().node_text(n)).alias("t")).collect()
    assert {r["page_id"]: r["t"] for r in rows} == {1: ["1", "2", "5"], 2: [], 3: []}


def test_plain_tags_read_as_the_standard_parser_reads_them(monkeypatch):
    import random

    parts = (
        '<div class="a  b">', "<DIV ID='x'>", '<a href="/x" Href="y">', '<a href="a&amp;b">', "<a b=c>", '<a b="c"d="e">', '<a b="x', "</div >", "</a x>",
        "</DIV>", "<p>", "</p>", "<li>", "<br>", "<br/>", "<b/>", "<script>", "</script>", "<title>", "</title>", "<template>", "</template>", "<!-- c -->",
        "<!doctype html>", "&lt", "&#39;", "&", "t ", "\n", "x<y", "<", ">", '"', "</", "<a\x0bb=\"c\">", "<table>", "<td>", "<tr>", "<1>", "</>", "\x00",
    )
    pick = random.Random(3)
    pages = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 30))) for _ in range(1500)]
    fast = [shred(page) for page in pages]
    monkeypatch.setattr(html_operator._Shredder, "_plain", lambda self, i: i)
    assert fast == [shred(page) for page in pages]
