"""Page-level operators: profiling, record identity, images, links, and whole records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.functions import urls
from parcelweave.functions.transforms import empty_to_null, strip
from parcelweave.operators.html import shred_html
from parcelweave.operators.mapping import apply_mapping
from parcelweave.operators.selectors import Page, bound, extract_all, extract_fields, select
from parcelweave.operators.validation import validation_errors

# Texts that mark a blocked page.
BLOCK_MARKERS = (
    "cf-browser-verification", "cloudflare", "checking your browser", "ddos protection",
    "access denied", "captcha", "robot check",
)
# Kinds of blocked page in order of precedence, with the texts that show them.
BLOCK_TYPES = {
    "cloudflare": ("cf-browser-verification", "cloudflare"),
    "captcha": ("captcha",),
    "access_denied": ("access denied",),
    "ddos_protection": ("ddos protection",),
}
# Fields that may hold the record id, in order of preference.
ID_FIELDS = ("parcel_id", "parcel", "apn", "account", "id")

_URL_IN_STYLE = r"url\(['\"]?([^'\")]+)['\"]?\)"


def is_blocked(html: Column, markers: Sequence[str] = BLOCK_MARKERS) -> Column:
    lowered, result = F.lower(html), F.lit(False)
    for marker in markers:
        result = result | lowered.contains(marker)
    return result


def block_type(html: Column, types: Mapping[str, Sequence[str]] = BLOCK_TYPES) -> Column:
    lowered, chain = F.lower(html), F
    for name, markers in types.items():
        hit = lowered.contains(markers[0])
        for marker in markers[1:]:
            hit = hit | lowered.contains(marker)
        chain = chain.when(hit, name)
    return chain.otherwise(F.lit(None).cast("string"))


def page_title(html: Column) -> Column:
    return strip(F.regexp_extract(html, r"(?i)<title>(.*?)</title>", 1))


def page_profile(
    df: DataFrame,
    html_col: str = "html",
    markers: Sequence[str] = BLOCK_MARKERS,
    types: Mapping[str, Sequence[str]] = BLOCK_TYPES,
) -> DataFrame:
    html = F.col(html_col)
    return df.select(
        *[c for c in df.columns if c != html_col],
        is_blocked(html, markers).alias("is_blocked"),
        block_type(html, types).alias("block_type"),
        F.length(html).cast("bigint").alias("html_length"),
        F.octet_length(html).cast("bigint").alias("size_bytes"),
        page_title(html).alias("title"),
    )


def resolve_record_id(columns: Sequence[str], fields: Sequence[str]) -> Column:
    """First usable id field, else the first field that looks like an id, else ``unknown``."""
    named = [empty_to_null(F.col(f).cast("string")) for f in ID_FIELDS if f in columns]

    def looks_like_id(name: str) -> Column:
        value = F.col(name)
        return F.when((F.length(value) >= 6) & value.rlike(r"\p{Nd}"), value)

    return F.coalesce(*named, *[looks_like_id(f) for f in fields], F.lit("unknown"))


def image_candidates(page: Page, config: Mapping | None = None) -> Column:
    """Image URLs of a page in order: configured selector, img tags, inline and block styles."""
    none = F.array().cast("array<string>")
    configured = none
    if config and config.get("selector"):
        configured = extract_all(page, {**config, "attr": config.get("attr", "src")})
    img_tags = F.transform(
        F.filter(page.nodes, lambda n: n["tag"] == "img"),
        lambda n: F.concat(
            F.array(urls.absolute_scheme(F.coalesce(n["attrs"]["src"], F.lit("")))),
            F.coalesce(urls.parse_srcset(n["attrs"]["srcset"]), none),
        ),
    )
    inline = F.transform(
        F.filter(page.nodes, lambda n: n["attrs"]["style"].isNotNull()),
        lambda n: urls.absolute_scheme(
            F.regexp_extract(n["attrs"]["style"], r"background-image:\s*" + _URL_IN_STYLE, 1)
        ),
    )
    blocks = F.transform(
        F.filter(page.nodes, lambda n: n["tag"] == "style"),
        lambda n: F.transform(
            F.regexp_extract_all(n["raw_text"], F.lit(_URL_IN_STYLE), F.lit(1)), urls.absolute_scheme
        ),
    )
    return F.concat(configured, F.flatten(img_tags), inline, F.flatten(blocks))


def extract_images(page: Page, config: Mapping | None = None) -> Column:
    return urls.keep_images(image_candidates(page, config))


def discovery_rules(config: Mapping) -> Mapping[str, Mapping]:
    """Link rules, whichever of the accepted places of the configuration holds them."""
    discovery = config.get("discovery", {})
    for nested in ("links", "rules"):
        if isinstance(discovery.get(nested), Mapping):
            return discovery[nested]
    return discovery


def _as_links(found: Column, relation: Column, delta: Column) -> Column:
    return F.transform(
        found,
        lambda u: F.struct(u.alias("url"), relation.alias("relationship_type"), delta.alias("priority_delta")),
    )


def discover_links(page: Page, rules: Mapping[str, Mapping]) -> Column:
    """Array of url, relationship_type and priority_delta over all rules, in rule order."""
    found = []
    for name, rule in rules.items():
        if not isinstance(rule, Mapping) or not rule.get("selector"):
            continue
        relation = urls.relationship_of(F.lit(name))
        delta = urls.relationship_delta(relation)
        values = extract_all(page, {"selector": rule["selector"], "attr": rule.get("attr", "href")})
        found.append(_as_links(F.filter(values, lambda u: u.startswith("http")), relation, delta))
    if not found:
        return F.array().cast("array<struct<url:string,relationship_type:string,priority_delta:int>>")
    return F.concat(*found)


def parse_pages(df: DataFrame, config: Mapping, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One record per page from configuration: extract, map, check, identify, and collect links.

    Errors are reported beside the record and never drop it. One narrow stage, no shuffle.
    """
    shredded = shred_html(df.withColumnRenamed(html_col, "html"), keep=[id_col])
    page = Page.columns()
    base = [id_col, "nodes", "page_text", "html"]
    prefix = "__raw_"
    raw = shredded.select(
        *base, *[c.alias(prefix + n) for n, c in zip(config["selectors"], extract_fields(page, config["selectors"]))]
    )
    mapping = config.get("mapping", {})
    fields = mapping.get("fields") or {name: {"source": name} for name in config["selectors"]}
    # Raw names get a prefix, so that a selector may share its name with a page column.
    renamed = {
        name: {**spec, "source": prefix + spec["source"]} if spec.get("source") else spec
        for name, spec in fields.items()
    }
    mapped = apply_mapping(raw, renamed, keep=base)
    texts = [f for f in fields if mapped.schema[f].dataType.simpleString() == "string"]
    latitude = urls.first_number([F.col(f) for f in urls.LATITUDE_FIELDS if f in fields])
    longitude = urls.first_number([F.col(f) for f in urls.LONGITUDE_FIELDS if f in fields])
    rules = config.get("business_rules") or {"required": mapping.get("required", [])}
    return mapped.select(
        id_col,
        resolve_record_id(list(fields), texts).alias("parcel_id"),
        F.struct(*[F.col(f) for f in fields]).alias("data"),
        validation_errors(list(fields), rules).alias("errors"),
        extract_images(page, mapping.get("images")).alias("image_urls"),
        urls.map_links(latitude, longitude).alias("external_links"),
        discover_links(page, discovery_rules(config)).alias("links"),
    )


def selector_coverage(df: DataFrame, selectors: Mapping[str, Mapping], keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Pages, hits and hit rate of every selector over all given pages."""
    found = shred_html(df, keep=list(keep)).select(*extract_fields(Page.columns(), selectors))
    counted = found.agg(
        F.count("*").alias("pages"), *[F.count(F.col(name)).alias(name) for name in selectors]
    )
    long = counted.unpivot("pages", list(selectors), "selector", "hits")
    return long.select(
        "selector", "pages", "hits",
        F.when(F.col("pages") > 0, F.round(F.col("hits") / F.col("pages"), 4)).alias("coverage"),
    )


def table_extract(page: Page, row_selector: str, cell_selector: str, nth: int) -> Column:
    """Text of the first matching cell inside the nth matching row."""
    rows = select(page, row_selector)
    cells = select(page, cell_selector)
    near = bound(
        pick_row(rows, nth),
        lambda row: F.filter(cells, lambda c: (row["pre"] < c["pre"]) & (c["pre"] <= row["post"])),
    )
    value = F.transform(F.slice(near, 1, 1), page.node_text)
    return F.get(value, F.lit(0))


def pick_row(rows: Column, nth: int) -> Column:
    return F.try_element_at(rows, F.lit(nth if nth < 0 else nth + 1))
