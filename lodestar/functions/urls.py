"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.text import trim_space

# Query parameters that only track.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "utm_reader", "utm_social",
    "utm_brand", "utm_pubreferrer", "utm_swu", "gclid", "fbclid", "msclkid", "dclid", "yclid", "twclid", "igshid", "mc_cid",
    "mc_eid", "_hsenc", "_hsmi", "ref", "ref_src", "spm", "from_source",
]


def canonical_url(c: Column) -> Column:
    """No fragment, no tracking parameters, lower-case scheme, no slash at the path's end."""
    bare = F.regexp_replace(trim_space(c), r"#[\s\S]*$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\?[\s\S]*$", ""), "^HTTP://", "http://"), "^HTTPS://", "https://")
    query = F.when(F.locate("?", bare) > 0, F.regexp_replace(bare, r"^[^?]*\?", "")).otherwise(F.lit(""))
    kept = F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING))
    return F.concat(F.regexp_replace(path, "(?<!:/)/$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def url_host(c: Column) -> Column:
    """The host in lower case without scheme, user, port and www."""
    rest = F.regexp_replace(F.regexp_replace(trim_space(c), "^.*?://", ""), r"[/?#][\s\S]*$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "^.*@", ""), r":[\s\S]*$", ""), r"^www\.", ""))
