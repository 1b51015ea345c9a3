"""Canonical form of URLs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host; null where there is none."""
    return F.nullif(F.regexp_extract(F.lower(url), r"^https?://([^/?#:]+)", 1), F.lit(""))


#: Parameters that only track where a visitor came from.
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"


def canonical(url: Column) -> Column:
    """Host, path and query of a URL: scheme, ``www.``, default port, fragment, last slash and tracking parameters dropped.

    Other parameters stay, in their order; null gives null.
    """
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"(?s)#.*$", "")
    front, asked = F.substring_index(bare, "?", 1), F.regexp_extract(bare, r"(?s)\?(.*)$", 1)
    at = F.regexp_replace(F.lower(F.regexp_extract(front, r"^([^/]*)", 1)), r"^(www\.)|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(front, r"(?s)^[^/]*(.*)$", 1), r"/+$", "")
    kept = F.filter(F.split(asked, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    return F.concat(at, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


_BARE = r"regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '', 's')"
_FRONT = f"split_part({_BARE}, '?', 1)"
_KEPT = rf"list_filter(string_split(regexp_extract({_BARE}, '\?(.*)$', 1, 's'), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))"
CANONICAL_SQL = rf"""
    regexp_replace(lower(regexp_extract({_FRONT}, '^([^/]*)', 1)), '^(www\.)|:(80|443)$', '', 'g')
    || regexp_replace(regexp_extract({_FRONT}, '^[^/]*(.*)$', 1, 's'), '/+$', '') || CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string({_KEPT}, '&') ELSE '' END"""
