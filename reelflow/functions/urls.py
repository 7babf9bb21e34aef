"""Video URL canonicalisation (URL-1 … URL-4). All ``Column -> Column``.

URL parts are split with the same rules as Python's ``urllib.parse.urlsplit``
(fragment at the first ``#``, query at the first ``?``, network location after
``//``) rather than ``java.net.URI``, which rejects many real-world URLs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelflow.fixed_values import SHORTS_PATTERN, WATCH_PREFIX

NETLOC_PATTERN = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
PATH_PATTERN = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)"
QUERY_PATTERN = r"^[^#?]*\?([^#]*)"
V_PARAM_PATTERN = r"(?:^|&)(?:v|%76)=([^&]+)"
STRAY_PERCENT = r"%(?![0-9A-Fa-f]{2})"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def shorts_id(url) -> Column:
    """URL-1: id from a ``/shorts/<id>`` URL (≥ 5 chars), else NULL."""
    return F.nullif(F.regexp_extract(_c(url), SHORTS_PATTERN, 1), F.lit(""))


def netloc(url) -> Column:
    return F.regexp_extract(_c(url), NETLOC_PATTERN, 1)


def short_host_id(url) -> Column:
    """URL-3: path id of a ``youtu.be`` URL (host equal, leading ``/`` removed), else NULL."""
    u = _c(url)
    path_id = F.regexp_replace(F.regexp_extract(u, PATH_PATTERN, 1), r"^/+", "")
    return F.when(netloc(u) == "youtu.be", F.nullif(path_id, F.lit("")))


def v_param(url) -> Column:
    """URL-4: first non-blank ``v`` query value, percent-decoded; a stray ``%`` stays as it is.

    The key may itself be percent-encoded.
    """
    raw = F.regexp_extract(F.regexp_extract(_c(url), QUERY_PATTERN, 1), V_PARAM_PATTERN, 1)
    whole = F.regexp_replace(raw, STRAY_PERCENT, "%25")
    return F.coalesce(F.try_url_decode(F.nullif(whole, F.lit(""))), F.nullif(raw, F.lit("")))


def canonical_url(url) -> Column:
    """URL-2: shorts → short host → already a watch URL → any ``v=`` → unchanged."""
    u = _c(url)
    return (F.when(shorts_id(u).isNotNull(), F.concat(F.lit(WATCH_PREFIX), shorts_id(u)))
             .when(short_host_id(u).isNotNull(), F.concat(F.lit(WATCH_PREFIX), short_host_id(u)))
             .when(u.contains("youtube.com/watch"), u)
             .when(v_param(u).isNotNull(), F.concat(F.lit(WATCH_PREFIX), v_param(u)))
             .otherwise(u))


def watch_id(canonical) -> Column:
    """Video id of a canonical watch URL, else NULL."""
    return F.nullif(F.regexp_extract(_c(canonical), r"^https://www\.youtube\.com/watch\?v=([^&#]+)", 1),
                    F.lit(""))
