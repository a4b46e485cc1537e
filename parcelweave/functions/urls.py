"""URL, image, link and map-link expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelweave.functions.transforms import WHITESPACE, parse_float, strip

# Image URLs containing one of these words are decoration or trackers.
IMAGE_EXCLUDE_WORDS = (
    "icon", "logo", "spinner", "loader", "avatar", "thumb", "pixel",
    "analytics", "tracking", "doubleclick", "googletagmanager",
)
# Accepted image file extensions.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg")
# Relationship words in order of precedence, and their priority deltas.
RELATIONSHIP_DELTAS = {"owner": 5, "county": 3, "parcel": 2, "neighbor": 1}
# Accepted names of coordinate fields, in order of preference.
LATITUDE_FIELDS = ("latitude", "lat", "y")
LONGITUDE_FIELDS = ("longitude", "lon", "lng", "x")


def id_from_url(url: Column, marker: str = "KeyValue=") -> Column:
    return F.substring_index(url, marker, -1)


def url_parts(url: Column) -> Column:
    """Struct of scheme, host, path, query and fragment; null parts for malformed URLs."""
    names = ("protocol", "host", "path", "query", "ref")
    return F.struct(*[F.try_parse_url(url, F.lit(n.upper())).alias(n) for n in names])


def absolute_scheme(url: Column) -> Column:
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)


def parse_srcset(srcset: Column) -> Column:
    first_words = F.transform(
        F.split(srcset, ","), lambda item: absolute_scheme(F.split(strip(item), rf"{WHITESPACE}+")[0])
    )
    return F.filter(first_words, lambda u: u != "")


def keep_images(
    candidates: Column,
    exclude: Sequence[str] = IMAGE_EXCLUDE_WORDS,
    extensions: Sequence[str] = IMAGE_EXTENSIONS,
) -> Column:
    """Drop blanks, inlined data, decoration and non-images; first occurrence order is kept."""
    unwanted = "(?i)" + "|".join(exclude)
    wanted_end = "(?:" + "|".join(e.replace(".", r"\.") for e in extensions) + r")\z"

    def keep(url: Column) -> Column:
        path = F.substring_index(F.lower(url), "?", 1)
        return (url != "") & ~url.startswith("data:") & ~url.rlike(unwanted) & path.rlike(wanted_end)

    return F.array_distinct(F.filter(F.transform(candidates, strip), keep))


def relationship_of(rule_name: Column) -> Column:
    name = F.lower(rule_name)
    chain = F
    for word in RELATIONSHIP_DELTAS:
        chain = chain.when(name.contains(word), word)
    return chain.otherwise("unknown")


def relationship_delta(relationship: Column, overrides: dict[str, int] | None = None) -> Column:
    kind = F.lower(relationship)
    chain = F
    for word, delta in {**RELATIONSHIP_DELTAS, **(overrides or {})}.items():
        chain = chain.when(kind == word, delta)
    return chain.otherwise(0)


def first_number(candidates: Sequence[Column]) -> Column:
    if not candidates:
        return F.lit(None).cast("double")
    return F.coalesce(*[parse_float(c) for c in candidates])


def map_links(latitude: Column, longitude: Column, address: Column | None = None) -> Column:
    """Map of service name to URL; null unless both coordinates are present and not zero."""
    lat, lon = latitude.cast("string"), longitude.cast("string")
    comma = F.concat(lat, F.lit(","), lon)
    google = "https://www.google.com/maps"
    links = {
        "google_maps": F.concat(F.lit(f"{google}?q="), comma),
        "google_street_view": F.concat(F.lit(f"{google}/@?api=1&map_action=pano&viewpoint="), comma),
        "google_satellite": F.concat(F.lit(f"{google}?q="), comma, F.lit("&t=k")),
        "bing_maps": F.concat(F.lit("https://www.bing.com/maps?cp="), lat, F.lit("~"), lon, F.lit("&lvl=17")),
        "apple_maps": F.concat(F.lit("https://maps.apple.com/?ll="), comma),
    }
    built = F.map_from_arrays(F.array(*[F.lit(k) for k in links]), F.array(*links.values()))
    if address is not None:
        query = F.regexp_replace(F.translate(address, " ", "+"), ",", "")
        by_address = F.create_map(
            F.lit("google_maps_address"), F.concat(F.lit(f"{google}/search/"), query)
        )
        built = F.when(address != "", F.map_concat(built, by_address)).otherwise(built)
    return F.when((latitude != 0) & (longitude != 0), built)
