"""What a link target says about itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesieve.functions.arrays import let

_SCHEME = r"\A([A-Za-z][A-Za-z0-9+.-]*):"
_HOST = (
    r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?"
    r"(\[[^\]/?#]*\]|[^/?#:@\[\]]+)"
)


def link_kind(href: Column) -> Column:
    """The lower-case scheme (``https``, ``tel``, ...) of a target that has one,
    else ``fragment``, ``scheme-relative`` or ``relative``."""
    scheme = F.lower(F.get(F.regexp_extract_all(href, F.lit(_SCHEME), F.lit(1)), F.lit(0)))
    return F.coalesce(
        scheme,
        F.when(href.startswith("#"), "fragment")
        .when(href.startswith("//"), "scheme-relative")
        .when(href.isNotNull(), "relative"),
    )


def link_host(href: Column) -> Column:
    """The lower-case host named in the target, NULL where there is none.

    A pattern rather than a strict URL parse: a bad percent escape or a raw
    non-ASCII path must not cost the host.
    """
    return F.lower(F.get(F.regexp_extract_all(href, F.lit(_HOST), F.lit(1)), F.lit(0)))


# Scheme with its colon, authority with its slashes, path, query with "?", fragment with "#".
_PARTS = r"\A([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#(?s:.*))?\z"
_DOTS = r"(\A|/)\.\.?(/|\z)"


def resolve(base: Column, href: Column) -> Column:
    """The URL that ``href`` means on the page at ``base``, without its fragment.

    As RFC 3986, 5.2 has it: relative paths, dot segments, empty paths, queries alone and
    targets with a scheme or host of their own. Scheme and host come in small letters and
    an empty path behind a host as "/". NULL if one of the two is NULL or the result has
    no scheme.
    """
    parts = lambda url: F.struct(
        F.lower(F.regexp_extract(url, _PARTS, 1)).alias("scheme"),
        F.lower(F.regexp_extract(url, _PARTS, 2)).alias("host"),
        F.regexp_extract(url, _PARTS, 3).alias("path"),
        F.regexp_extract(url, _PARTS, 4).alias("query"),
    )

    def joined(b: Column, r: Column) -> Column:
        own = r["scheme"] != ""
        own_host = own | (r["host"] != "")
        same_page = ~own_host & (r["path"] == "")
        folder = F.when((b["host"] != "") & (b["path"] == ""), "/").otherwise(
            F.regexp_replace(b["path"], r"[^/]*\z", "")
        )
        scheme = F.when(own, r["scheme"]).otherwise(b["scheme"])
        host = F.when(own_host, r["host"]).otherwise(b["host"])
        path = (
            F.when(same_page, b["path"])
            .when(own_host | r["path"].startswith("/"), r["path"])
            .otherwise(F.concat(folder, r["path"]))
        )
        query = F.when(same_page & (r["query"] == ""), b["query"]).otherwise(r["query"])
        path = let(path, _without_dots)
        path = F.when((host != "") & (path == ""), "/").otherwise(path)
        return F.when(scheme != "", F.concat(scheme, host, path, query))

    return let(F.struct(parts(base).alias("b"), parts(F.trim(href)).alias("r")), lambda x: F.when(
        base.isNotNull() & href.isNotNull(), joined(x["b"], x["r"])
    ))


def _without_dots(path: Column) -> Column:
    """``path`` without the segments "." and ".."; a ".." takes the one before it along."""
    root = F.when(path.startswith("/"), 1).otherwise(0)
    segments = F.split(path, "/", -1)
    last = F.element_at(segments, -1)
    walked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda kept, s: F.when(s == ".", kept)
        .when((s == "..") & (F.size(kept) > root), F.slice(kept, 1, F.size(kept) - 1))
        .when(s == "..", kept)
        .otherwise(F.array_append(kept, s)),
    )
    # A last "." or ".." names a folder.
    walked = F.when(last.isin(".", ".."), F.array_append(walked, F.lit(""))).otherwise(walked)
    return F.when(path.rlike(_DOTS), F.array_join(walked, "/")).otherwise(path)
