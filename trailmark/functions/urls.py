"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions.text import strip


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def is_absolute(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


def is_navigation_url(url: Column, current: Column) -> Column:
    link = strip(F.coalesce(url, F.lit("")))
    here = F.coalesce(current, F.lit(""))
    same_page = link.contains("#") & (F.substring_index(link, "#", 1) == F.substring_index(here, "#", 1))
    return is_absolute(link) & ~same_page & (link != here)


def resolve(base: Column, link: Column) -> Column:
    """``link`` made absolute against ``base``; dot segments are kept as written."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*/)", 1), F.lit("")), F.lit("/"))
    no_fragment = F.substring_index(base, "#", 1)
    return (
        F.when(link == "", base)
        .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("#"), F.concat(no_fragment, link))
        .when(link.startswith("?"), F.concat(root, path, link))
        .otherwise(F.concat(root, folder, link))
    )


def clean_url(url: Column) -> Column:
    """Local host by its number, without one trailing slash."""
    local = F.replace(url, F.lit("localhost"), F.lit("127.0.0.1"))
    return F.regexp_replace(local, r"/\z", "")


def url_match(url: Column, references: Column, rule: Column) -> Column:
    """1.0 or 0.0; null for an unknown rule. ``references`` holds alternatives split by `` |OR| ``."""
    page = clean_url(url)
    options = F.transform(F.split(references, r" \|OR\| "), clean_url)
    return (
        F.when(rule == "EXACT", F.array_contains(options, page).cast("double"))
        .when(rule == "GOLD in PRED", F.exists(options, lambda o: page.contains(o)).cast("double"))
    )


def replace_placeholders(text: Column, mapping: dict[str, str]) -> Column:
    for mark, value in mapping.items():
        text = F.replace(text, F.lit(mark), F.lit(value))
    return text


def map_url(url: Column, mapping: dict[str, str], to_real: bool) -> Column:
    """Swap local and public addresses; back to local also for the https spelling."""
    for local, real in mapping.items():
        if to_real:
            url = F.replace(url, F.lit(local), F.lit(real))
        else:
            url = F.replace(url, F.lit(real), F.lit(local))
            url = F.replace(url, F.lit(real.replace("http", "https")), F.lit(local))
    return url


def post_url(url: Column, prefix: str = "f") -> Column:
    """``scheme://host/f/{forum}/{id}/`` of a forum page, other URLs unchanged."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.split(path, "/")
    root = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    forum = (F.size(parts) >= 4) & (F.get(parts, F.lit(1)) == prefix)
    built = F.concat(root, F.lit(f"/{prefix}/"), F.get(parts, F.lit(2)), F.lit("/"), F.get(parts, F.lit(3)), F.lit("/"))
    return F.when(forum, built).otherwise(url)
