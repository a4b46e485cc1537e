"""Driver queries over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelweave.functions import urls
from parcelweave.functions.transforms import empty_to_null, normalize_name, strip
from parcelweave.operators import pages as P
from parcelweave.operators.html import node_table, shred_html
from parcelweave.operators.selectors import Page, extract, extract_all, pick, select, select_regex
from parcelweave.operators.validation import validate_records
from parcelweave.plans.registry import query
from parcelweave.plans.tables import decoded_sql, load

# Words that occur in the advertising blocks of these pages stand in for block markers.
MARKERS = ("nicht", "ction", "pour")
TYPES = {"cloudflare": ("nicht", "aulich"), "captcha": ("ction",), "access_denied": ("pour",)}
_HREF = r'<a href="(/[^"]*)"'
_HOST_SQL = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
_LINKS_SQL = r"""regexp_extract_all(html, '<a href="(/[^"]*)"', 1)"""
_TITLE_SQL = "trim(regexp_extract(html, '(?i)<title>(.*?)</title>', 1))"
_DECODED_H1_SQL = decoded_sql("regexp_extract(html, '<h1>(.*?)</h1>', 1)")
_DECODED_TITLE_SQL = decoded_sql("regexp_extract(html, '<title>(.*?)</title>', 1)")


@query(
    f"""
SELECT page_id, url,
  contains(lower(html), 'nicht') OR contains(lower(html), 'ction') OR contains(lower(html), 'pour') AS is_blocked,
  CASE WHEN contains(lower(html), 'nicht') OR contains(lower(html), 'aulich') THEN 'cloudflare'
    WHEN contains(lower(html), 'ction') THEN 'captcha'
    WHEN contains(lower(html), 'pour') THEN 'access_denied' END AS block_type,
  CAST(length(html) AS BIGINT) AS html_length, CAST(strlen(html) AS BIGINT) AS size_bytes, {_TITLE_SQL} AS title
FROM pages"""
)
def page_profile(spark: SparkSession, sf: str) -> DataFrame:
    return P.page_profile(load(spark, sf, "pages"), markers=MARKERS, types=TYPES)


@query(
    f"""
WITH p AS (SELECT regexp_replace({_HOST_SQL}, '^.*?([^.]+[.][^.]+)$', '\\1') AS site, {_TITLE_SQL} AS title,
    len({_LINKS_SQL}) AS n_links FROM pages)
SELECT site, CAST(count(*) AS BIGINT) AS pages,
  CAST(count(*) FILTER (WHERE length(title) >= 60) AS BIGINT) AS long_titles,
  CAST(count(*) FILTER (WHERE title = '') AS BIGINT) AS missing_titles,
  CAST(sum(n_links) AS BIGINT) AS links, max(length(title)) AS longest_title
FROM p GROUP BY site"""
)
def page_title_by_host(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: extract, clean, check and aggregate per site, all in one scan."""
    page = load(spark, sf, "pages")
    site = F.regexp_replace(urls.url_parts(F.col("url"))["host"], r"^.*?([^.]+[.][^.]+)$", "$1")
    title = P.page_title(F.col("html"))
    n_links = F.size(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)))
    rows = page.select(site.alias("site"), title.alias("title"), n_links.alias("n_links"))
    checked = validate_records(rows, {"required": ["title"], "fields": {"title": {"max_length": 59}}})
    return checked.groupBy("site").agg(
        F.count("*").alias("pages"),
        F.count_if(F.length("title") >= 60).alias("long_titles"),
        F.count_if(F.array_contains("errors", "Missing required field: title")).alias("missing_titles"),
        F.sum("n_links").alias("links"),
        F.max(F.length("title")).cast("bigint").alias("longest_title"),
    )


@query(f"SELECT page_id, array_to_string({_LINKS_SQL}, ' ') AS links FROM pages")
def nav_links(spark: SparkSession, sf: str) -> DataFrame:
    page = Page(F.lit(None), F.lit(None), F.col("html"))
    return load(spark, sf, "pages").select("page_id", F.array_join(select_regex(page, _HREF), " ").alias("links"))


@query(f"SELECT page_id, array_to_string({_LINKS_SQL}, ' ') AS links FROM pages")
def css_nav_links(spark: SparkSession, sf: str) -> DataFrame:
    shredded = shred_html(load(spark, sf, "pages"), keep=["page_id"], keep_html=False)
    values = extract_all(Page.columns(), {"selector": "nav > ul li a[href^='/']", "attr": "href"})
    return shredded.select("page_id", F.array_join(values, " ").alias("links"))


@query(
    f"""
SELECT page_id, l[2] AS second, CASE WHEN len(l) > 0 THEN l[len(l)] END AS last, array_to_string(l[1:len(l):2], ' ') AS odd
FROM (SELECT page_id, {_LINKS_SQL} AS l FROM pages)"""
)
def css_nth_child(spark: SparkSession, sf: str) -> DataFrame:
    """Links by their place in the list."""
    shredded = shred_html(load(spark, sf, "pages"), keep=["page_id"], keep_html=False)
    page = Page.columns()
    return shredded.select(
        "page_id",
        extract(page, {"selector": "nav li:nth-child(2) > a", "attr": "href"}).alias("second"),
        extract(page, {"selector": "nav li:last-child a", "attr": "href"}).alias("last"),
        F.array_join(extract_all(page, {"selector": "nav li:nth-child(odd) a", "attr": "href"}), " ").alias("odd"),
    )


@query(
    f"""
SELECT page_id, array_to_string(l[2:], ' ') AS later,
  CAST(len(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>')) AS INT) AS paragraphs
FROM (SELECT page_id, html, {_LINKS_SQL} AS l FROM pages)"""
)
def css_not(spark: SparkSession, sf: str) -> DataFrame:
    """Links but the first, and paragraphs that follow the heading."""
    shredded = shred_html(load(spark, sf, "pages"), keep=["page_id"], keep_html=False)
    page = Page.columns()
    return shredded.select(
        "page_id",
        F.array_join(extract_all(page, {"selector": "nav li:not(:first-child) a:not([name], .x)", "attr": "href"}), " ").alias("later"),
        F.size(select(page, "article h1 ~ p:not(.ad)")).alias("paragraphs"),
    )


@query(f"SELECT page_id, array_to_string({_LINKS_SQL}, ' ') AS links FROM pages")
def regex_named_group(spark: SparkSession, sf: str) -> DataFrame:
    page = Page(F.lit(None), F.lit(None), F.col("html"))
    found = select_regex(page, r'<a href=(?P<quote_mark>")(?:/[^"]*)(?P=quote_mark)')
    whole = select_regex(page, r'<a href="(?P<path_part>/[^"]*)"')
    # The first group counts: a quotation mark for each link there, the path here.
    same = F.size(found) == F.size(whole)
    return load(spark, sf, "pages").select("page_id", F.when(same, F.array_join(whole, " ")).alias("links"))


@query(f"SELECT page_id, {_DECODED_H1_SQL} AS heading, array_to_string({_LINKS_SQL}, ' ') AS links, 299 AS inner_wrappers FROM pages")
def deep_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages inside 300 nested elements: text, links and nesting are found at any depth."""
    wrapped = F.concat(F.repeat(F.lit('<div class="wrap">'), 300), "html", F.repeat(F.lit("</div>"), 300))
    pages = load(spark, sf, "pages").select("page_id", wrapped.alias("html"))
    shredded, page = shred_html(pages, keep=["page_id"], keep_html=False), Page.columns()
    return shredded.select(
        "page_id",
        extract(page, {"selector": "div.wrap article h1"}).alias("heading"),
        F.array_join(extract_all(page, {"selector": "div.wrap div.wrap nav > ul li a", "attr": "href"}), " ").alias("links"),
        F.size(select(page, "div.wrap > div.wrap")).alias("inner_wrappers"),
    )


@query(f"SELECT page_id, {_DECODED_H1_SQL} AS heading FROM pages")
def xpath_h1(spark: SparkSession, sf: str) -> DataFrame:
    shredded = shred_html(load(spark, sf, "pages"), keep=["page_id"], keep_html=False)
    heading = extract(Page.columns(), {"selector": "//h1", "type": "xpath"})
    return shredded.select("page_id", heading.alias("heading"))


@query(
    r"""SELECT tag, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT page_id) AS BIGINT) AS pages
FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<script>.*?</script>', '<script>', 'g'),
  '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1"""
)
def node_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Elements per tag over all pages."""
    nodes = node_table(shred_html(load(spark, sf, "pages"), keep=["page_id"], keep_html=False))
    per_page = nodes.groupBy("tag", "page_id").agg(F.count("*").alias("n"))
    return per_page.groupBy("tag").agg(F.sum("n").alias("n"), F.count("*").alias("pages"))


def _paragraph_sql(which: str) -> str:
    """Text of one piece of the article: tags cut it into text nodes, which are stripped and joined."""
    piece = f"regexp_replace(({which}), '(?s)</p>.*$', '')"
    nodes = f"regexp_split_to_array({piece}, '<[^>]*>')"
    node = decoded_sql("x").removeprefix("trim(").removesuffix(")")
    stripped = f"regexp_replace({node}, '^\\s+|\\s+$', '', 'g')"
    return f"array_to_string(list_transform({nodes}, lambda x: {stripped}), '')"


@query(
    f"""
WITH p AS (SELECT page_id, string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>') AS pieces,
  regexp_extract(html, '(?s)<div class="ad">.*?</div>') AS ad FROM pages)
SELECT page_id, nullif({_paragraph_sql("pieces[3]")}, '') AS second,
  CASE WHEN len(pieces) > 1 THEN {_paragraph_sql("pieces[len(pieces)]")} END AS last, nullif(ad, '') AS ad_html FROM p"""
)
def css_paragraph_index(spark: SparkSession, sf: str) -> DataFrame:
    shredded = shred_html(load(spark, sf, "pages"), keep=["page_id"])
    page = Page.columns()
    return shredded.select(
        "page_id",
        empty_to_null(extract(page, {"selector": "article p", "index": 1})).alias("second"),
        extract(page, {"selector": "article > p", "index": -1}).alias("last"),
        extract(page, {"selector": "div.ad", "attr": "html"}).alias("ad_html"),
    )


@query(
    r"""
WITH links AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS href, url FROM pages),
named AS (SELECT 'https://' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || href AS target,
  CASE WHEN regexp_matches(lower(href), '^/[a-e]') THEN 'owner' WHEN regexp_matches(lower(href), '^/[f-m]') THEN 'county'
    WHEN regexp_matches(lower(href), '^/[n-s]') THEN 'parcel' WHEN regexp_matches(lower(href), '^/[t-z]') THEN 'neighbor'
    ELSE 'unknown' END AS relationship_type FROM links)
SELECT relationship_type,
  CAST(CASE relationship_type WHEN 'owner' THEN 5 WHEN 'county' THEN 3 WHEN 'parcel' THEN 2 WHEN 'neighbor' THEN 1
    ELSE 0 END AS INT) AS priority_delta,
  CAST(count(*) AS BIGINT) AS links, CAST(count(DISTINCT target) AS BIGINT) AS targets
FROM named GROUP BY 1, 2"""
)
def link_relationships(spark: SparkSession, sf: str) -> DataFrame:
    host = urls.url_parts(F.col("url"))["host"]
    hrefs = load(spark, sf, "pages").select(
        host.alias("host"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("href")
    )
    rule = F
    for letters, name in (("a-e", "owner_links"), ("f-m", "county_links"), ("n-s", "parcel_links"), ("t-z", "neighbor_links")):
        rule = rule.when(F.lower("href").rlike(f"^/[{letters}]"), name)
    relation = urls.relationship_of(rule.otherwise("other"))
    named = hrefs.select(
        F.concat(F.lit("https://"), "host", "href").alias("target"), relation.alias("relationship_type")
    )
    # Targets are unique before they are counted, so no task holds a set of them.
    per_target = named.groupBy("relationship_type", "target").agg(F.count("*").alias("n"))
    counted = per_target.groupBy("relationship_type").agg(F.sum("n").alias("links"), F.count("*").alias("targets"))
    return counted.select(
        "relationship_type", urls.relationship_delta(F.col("relationship_type")).alias("priority_delta"), "links", "targets"
    )


@query(
    f"""
WITH c AS (SELECT count(*) AS pages,
  count(*) FILTER (WHERE regexp_matches(html, '<h1>')) AS heading,
  count(*) FILTER (WHERE regexp_matches(html, '<div class="ad">')) AS ad,
  count(*) FILTER (WHERE len({_LINKS_SQL}) >= 4) AS fourth_link,
  0 AS photo FROM pages)
SELECT selector, CAST(pages AS BIGINT) AS pages, CAST(hits AS BIGINT) AS hits, round(hits / pages, 4) AS coverage
FROM (SELECT pages, unnest(['heading', 'ad', 'fourth_link', 'photo']) AS selector,
  unnest([heading, ad, fourth_link, photo]) AS hits FROM c)"""
)
def selector_coverage(spark: SparkSession, sf: str) -> DataFrame:
    selectors = {
        "heading": {"selector": "article h1"},
        "ad": {"selector": "div.ad"},
        "fourth_link": {"selector": "nav li > a", "attr": "href", "index": 3},
        "photo": {"selector": "img.photo", "attr": "src"},
    }
    return P.selector_coverage(load(spark, sf, "pages"), selectors)


@query("SELECT page_id, CASE WHEN contains(url, 'page=') THEN regexp_extract(url, '.*page=(.*)$', 1) ELSE url END AS record_id FROM pages")
def record_id_from_url(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", urls.id_from_url(F.col("url"), "page=").alias("record_id"))


@query(
    f"""
SELECT scheme, host, CAST(count(*) AS BIGINT) AS pages, CAST(count(query) AS BIGINT) AS with_query,
  CAST(count(fragment) AS BIGINT) AS with_fragment
FROM (SELECT regexp_extract(url, '^([a-z]+)://', 1) AS scheme, {_HOST_SQL} AS host,
  CASE WHEN regexp_matches(url, '[?]') THEN 1 END AS query, CASE WHEN contains(url, '#') THEN 1 END AS fragment FROM pages)
GROUP BY 1, 2"""
)
def url_groups(spark: SparkSession, sf: str) -> DataFrame:
    parts = load(spark, sf, "pages").select(urls.url_parts(F.col("url")).alias("u"))
    return parts.groupBy(F.col("u.protocol").alias("scheme"), F.col("u.host").alias("host")).agg(
        F.count("*").alias("pages"), F.count("u.query").alias("with_query"), F.count("u.ref").alias("with_fragment")
    )


@query(
    """
SELECT CASE WHEN contains(lower(html), 'nicht') OR contains(lower(html), 'aulich') THEN 'cloudflare'
    WHEN contains(lower(html), 'ction') THEN 'captcha' WHEN contains(lower(html), 'pour') THEN 'access_denied' END AS block_type,
  CAST(count(*) AS BIGINT) AS pages, CAST(sum(strlen(html)) AS BIGINT) AS bytes
FROM pages GROUP BY 1"""
)
def page_block_class(spark: SparkSession, sf: str) -> DataFrame:
    html = F.col("html")
    return (
        load(spark, sf, "pages")
        .groupBy(P.block_type(html, TYPES).alias("block_type"))
        .agg(F.count("*").alias("pages"), F.sum(F.octet_length(html).cast("bigint")).alias("bytes"))
    )


@query(
    r"""
WITH c AS (SELECT page_id, list_transform(regexp_extract_all(html, '<a href="(/[^"]*)"', 1), lambda h:
    'https://' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || replace(h, ',', '') ||
    CASE WHEN regexp_matches(h, '^/[a-mA-M]') THEN '.jpg' WHEN regexp_matches(h, '^/[n-s]') THEN '.PNG?w=9' ELSE '.html' END) AS u
  FROM pages),
k AS (SELECT page_id, list_filter(u, lambda x: NOT regexp_matches(x,
    '(?i)icon|logo|spinner|loader|avatar|thumb|pixel|analytics|tracking|doubleclick|googletagmanager')
    AND regexp_matches(split_part(lower(x), '?', 1), '[.](jpg|jpeg|png|gif|webp|svg)$')) AS u FROM c)
SELECT page_id, array_to_string(list_transform(list_filter(range(1, len(u) + 1), lambda i: list_position(u, u[i]) = i),
  lambda i: u[i]), ' ') AS images FROM k"""
)
def srcset_images(spark: SparkSession, sf: str) -> DataFrame:
    """Links of a page as one srcset attribute, parsed, filtered and made unique."""
    host = urls.url_parts(F.col("url"))["host"]
    hrefs = F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))
    entries = F.transform(
        hrefs,
        lambda h: F.concat(
            F.lit(" //"), host, F.regexp_replace(h, ",", ""),
            F.when(h.rlike("^/[a-mA-M]"), ".jpg").when(h.rlike("^/[n-s]"), ".PNG?w=9").otherwise(".html"),
            F.lit(" 2x"),
        ),
    )
    images = urls.keep_images(urls.parse_srcset(F.array_join(entries, ",")))
    return load(spark, sf, "pages").select("page_id", F.array_join(images, " ").alias("images"))


@query("""SELECT page_id, nullif(regexp_extract_all(html, '<li><a href="[^"]*">(.*?)</a>', 1)[3], '') AS cell FROM pages""")
def nav_cell(spark: SparkSession, sf: str) -> DataFrame:
    shredded = shred_html(load(spark, sf, "pages"), keep=["page_id"], keep_html=False)
    return shredded.select("page_id", P.table_extract(Page.columns(), "nav ul li", "li a", 2).alias("cell"))


# What these pages lack: pictures of all four kinds, absolute links, and a place, made of their own links.
_EXTRA_SQL = """list_transform(range(1, 7), lambda i: 'host.example' || coalesce(links[i], '/none'))"""


def _with_media(pages: DataFrame) -> DataFrame:
    hrefs = F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))
    at = lambda i: F.concat(F.lit("host.example"), F.coalesce(F.get(hrefs, F.lit(i)), F.lit("/none")))
    plain = lambda url: F.regexp_replace(url, ",", "")  # noqa: E731  commas part the entries of a srcset
    pieces = [
        '<img src="//', at(0), '.jpg"><img srcset="//', plain(at(1)), ".png 1x, https://", plain(at(2)), '.WEBP?w=2 2x, data:x 3x" src="">',
        "<div style=\"background-image: url('//", at(3), ".gif')\"></div><style>.b{background:url(//", at(4), ".svg)}</style>",
        '<a class="far" href="http://', at(5), '">far</a><a class="far" href="/near">near</a>',
        '<span id="lat">', F.lit(-40) + F.col("page_id") % 80, '.5</span><span id="lon">', F.col("page_id") % 170, ".25</span>",
    ]
    built = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces])
    return pages.withColumn("html", F.concat("html", built))


_MEDIA_CTE = f"""p AS (SELECT page_id, html, {_LINKS_SQL} AS links FROM pages),
m AS (SELECT *, {_EXTRA_SQL} AS x FROM p),
c AS (SELECT *, ['https://' || x[1] || '.jpg', 'https://' || replace(x[2], ',', '') || '.png',
  'https://' || replace(x[3], ',', '') || '.WEBP?w=2',
  'https://' || x[4] || '.gif', 'https://' || x[5] || '.svg'] AS u FROM m),
k AS (SELECT *, list_filter(u, lambda y: NOT regexp_matches(y,
  '(?i)icon|logo|spinner|loader|avatar|thumb|pixel|analytics|tracking|doubleclick|googletagmanager')) AS images FROM c)"""


@query(f"WITH {_MEDIA_CTE} SELECT page_id, array_to_string(images, ' ') AS images FROM k")
def page_images(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures from img tags, their srcset, inline styles and style blocks."""
    shredded = shred_html(_with_media(load(spark, sf, "pages")), keep=["page_id"], keep_html=False)
    return shredded.select("page_id", F.array_join(P.extract_images(Page.columns()), " ").alias("images"))


@query(f"WITH {_MEDIA_CTE} SELECT page_id, 'http://' || x[6] AS url, 'parcel' AS relationship_type, CAST(2 AS INT) AS priority_delta FROM k")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Absolute links by rule; what does not lead to the web is left out."""
    shredded = shred_html(_with_media(load(spark, sf, "pages")), keep=["page_id"], keep_html=False)
    rules = {"parcel_links": {"selector": "a.far"}, "owner_links": {"selector": "nav a"}}
    found = P.discover_links(Page.columns(), rules)
    return shredded.select("page_id", F.explode(found).alias("l")).select("page_id", "l.*")


PAGE_CONFIG = {
    "selectors": {
        "title": {"selector": "title"},
        "heading": {"selector": "article h1"},
        "account": {"selector": "nav li a", "attr": "href", "index": -1},
        "first_link": {"selector": r'<a href="(/[^"]*)"', "type": "regex"},
        "lat": {"selector": "#lat"},
        "lon": {"selector": "#lon"},
    },
    "mapping": {
        "fields": {
            "title": {"source": "title", "transform": "trim"},
            "account": {"source": "account", "transform": "clean_parcel_id"},
            "first_link": {"source": "first_link"},
            "lang": {"const": "mixed"},
            "lat": {"source": "lat"},
            "lon": {"source": "lon"},
        }
    },
    "business_rules": {"required": ["title", "account"], "fields": {"account": {"min_length": 4}}},
    "discovery": {"links": {"parcel_links": {"selector": "a[href]"}}},
}


@query(
    r"""
WITH __MEDIA__,
q AS (SELECT *, nullif(__TITLE__, '') AS title,
  nullif(upper(replace(regexp_replace(regexp_replace(replace(links[len(links)], 'ß', 'SS'), '(?i)^(APN|PARCEL|ID)[:\s]*', ''),
  '[^\p{L}\p{N}_-]', '', 'g'), '_', '-')), '') AS account,
  CASE WHEN page_id % 80 - 40 = -40 THEN '-40.5' ELSE (page_id % 80 - 40) || '.5' END AS lat, (page_id % 170) || '.25' AS lon FROM k)
SELECT page_id,
  coalesce(account, CASE WHEN length(title) >= 6 AND regexp_matches(title, '[0-9]') THEN title END,
    CASE WHEN length(links[1]) >= 6 AND regexp_matches(links[1], '[0-9]') THEN links[1] END, 'unknown') AS parcel_id,
  title, account, links[1] AS first_link,
  concat_ws('; ', CASE WHEN title IS NULL THEN 'Missing required field: title' END,
    CASE WHEN account IS NULL THEN 'Missing required field: account' END,
    CASE WHEN length(account) < 4 THEN 'Field ''account'' must be at least 4 characters' END) AS errors,
  array_to_string(images, ' ') AS images,
  'https://maps.apple.com/?ll=' || CAST(CAST(lat AS DOUBLE) AS VARCHAR) || ',' || CAST(CAST(lon AS DOUBLE) AS VARCHAR) AS apple,
  'http://' || x[6] || ' parcel 2' AS web_links
FROM q""".replace("__TITLE__", _DECODED_TITLE_SQL).replace("__MEDIA__", _MEDIA_CTE)
)
def parse_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The whole record: data, errors, pictures, map links and links."""
    records = P.parse_pages(_with_media(load(spark, sf, "pages")), PAGE_CONFIG)
    web = F.transform("links", lambda link: F.concat_ws(" ", link["url"], link["relationship_type"], link["priority_delta"].cast("string")))
    return records.select(
        "page_id", "parcel_id", "data.title", "data.account", "data.first_link",
        F.array_join("errors", "; ").alias("errors"),
        F.array_join("image_urls", " ").alias("images"),
        F.col("external_links")["apple_maps"].alias("apple"),
        F.array_join(web, "; ").alias("web_links"),
    )


@query(
    """
SELECT page_id, upper(left(lower(w), 1)) || substr(lower(w), 2) AS owner
FROM (SELECT page_id, regexp_extract_all(html, '<a href="/([a-zA-Z]+)"', 1)[1] AS w FROM pages)"""
)
def first_link_name(spark: SparkSession, sf: str) -> DataFrame:
    page = Page(F.lit(None), F.lit(None), F.col("html"))
    word = pick(select_regex(page, '<a href="/([a-zA-Z]+)"'), 0)
    return load(spark, sf, "pages").select("page_id", strip(normalize_name(word, {})).alias("owner"))
