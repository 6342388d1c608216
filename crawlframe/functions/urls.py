"""URL canonicalisation and resolution as native column expressions.

``parse_url`` refuses hosts and escapes that a crawler meets, so URLs are
taken apart with the regular expression of RFC 3986, appendix B.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlframe.functions.binding import let

_PARTS = r"(?s)^(?:([^:/?#]+):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
MAX_BYTES = 2048

# Query keys that only track.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "gclid", "gclsrc", "dclid",
    "fbclid", "fb_action_ids", "fb_action_types", "fb_source", "fb_ref",
    "msclkid",
    "_hsenc", "_hsmi", "hsa_cam", "hsa_grp", "hsa_mt", "hsa_src", "hsa_ad", "hsa_acc",
    "hsa_net", "hsa_ver", "hsa_la", "hsa_ol", "hsa_kw", "hsa_tgt",
    "mc_cid", "mc_eid",
    "ref", "referrer",
)


def part(url: Column, group: int) -> Column:
    """1 scheme, 2 authority with its //, 3 path, 4 query with its ?, 5 fragment; '' if there is none."""
    return F.regexp_extract(url, _PARTS, group)


def _valid(url: Column) -> Column:
    return url.isNotNull() & ~url.rlike("[\\x00-\\x1f\\x7f]|%(?![0-9A-Fa-f]{2})") & ~part(url, 2).rlike("[ <>\"{}|\\\\^`]")


def _decode(escaped: Column) -> Column:
    return F.try_url_decode(F.replace(escaped, F.lit("+"), F.lit("%2B")))


def _escape_path(path: Column) -> Column:
    def one(c: Column) -> Column:
        return F.when(c.rlike("^[A-Za-z0-9_.~$&+,/:;=@-]$"), c).otherwise(
            F.regexp_replace(F.hex(F.encode(c, "utf-8")), "(..)", "%$1")
        )

    return F.when(path.rlike("^[A-Za-z0-9_.~$&+,/:;=@-]*$"), path).otherwise(
        F.array_join(F.transform(F.split(path, "(?!^)"), one), "")
    )


def canonical_path(path: Column) -> Column:
    """'' becomes /, slashes at the end go, then runs of slashes collapse; an edited or unescaped path is escaped anew."""

    def edit(decoded: Column) -> Column:
        rooted = F.when(decoded == "", F.lit("/")).when(F.length(decoded) > 1, F.regexp_replace(decoded, "/+$", "")).otherwise(decoded)
        return let(F.regexp_replace(rooted, "/{2,}", "/"), _escape_path)

    edited = path.rlike("//|./$") | (path == "")
    escaped = path.rlike(r"^[A-Za-z0-9_.~$&+,/:;=@!*'()%\[\]-]*$")
    return F.when(~edited & escaped, path).otherwise(let(_decode(path), edit))


def canonical_query(query: Column) -> Column:
    """The query without its ?: tracking keys and keys whose only value is empty go, pairs are sorted and escaped as in forms."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.contains(";")),
        lambda p: F.struct(
            F.try_url_decode(F.regexp_extract(p, "(?s)^([^=]*)", 1)).alias("k"),
            F.try_url_decode(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    good = F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    kept = F.filter(
        good,
        lambda p: ~F.lower(p["k"]).isin(*TRACKING)
        & ~((p["v"] == "") & (F.size(F.filter(good, lambda q: q["k"] == p["k"])) == 1)),
    )
    form = lambda s: F.replace(F.replace(F.url_encode(s), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(form(p["k"]), F.lit("="), form(p["v"]))), "&")


def _host(authority: Column, scheme: Column) -> Column:
    """Lower-case host and port without the scheme's own port and one www."""
    place = F.lower(F.regexp_replace(F.substring(authority, 3, 1 << 20), "^.*@", ""))
    default = F.when(scheme == "http", place.rlike(":80$")).otherwise(place.rlike(":443$"))
    plain = F.when(default, F.regexp_replace(F.regexp_replace(place, ":[0-9]*$", ""), r"^\[|\]$", "")).otherwise(place)
    return F.regexp_replace(plain, r"^www\.", "")


def normalize_url(url: Column) -> Column:
    """The canonical form; '' unless it is a valid http or https URL."""

    def whole(p: Column) -> Column:
        user = F.regexp_extract(p["authority"], "^//(.*@)", 1)
        form = F.when(F.length(p["query"]) > 1, canonical_query(F.substring(p["query"], 2, 1 << 20))).otherwise(F.lit(""))
        shown = let(form, lambda f: F.when(f != "", F.concat(F.lit("?"), f)).when(p["query"] == "?", F.lit("?")).otherwise(F.lit("")))
        joined = F.concat(p["scheme"], F.lit("://"), user, _host(p["authority"], p["scheme"]), canonical_path(p["path"]), shown)
        return F.when(p["scheme"].isin("http", "https") & (F.length(p["authority"]) > 2), joined).otherwise(F.lit(""))

    parts = F.struct(
        F.lower(part(url, 1)).alias("scheme"), part(url, 2).alias("authority"), part(url, 3).alias("path"), part(url, 4).alias("query")
    )
    return F.when(_valid(url), let(parts, whole)).otherwise(F.lit(""))


def extract_domain(url: Column) -> Column:
    """Lower-case host without port and one www.; '' if the URL isn't valid."""
    place = F.lower(F.regexp_replace(F.substring(part(url, 2), 3, 1 << 20), "^.*@", ""))
    host = F.regexp_replace(F.regexp_replace(place, ":[0-9]*$", ""), r"^\[|\]$", "")
    return F.when(_valid(url), F.regexp_replace(host, r"^www\.", "")).otherwise(F.lit(""))


def remove_dots(path: Column) -> Column:
    """A rooted path without its . and .. segments."""
    segments = F.split(F.substring(path, 2, 1 << 20), "/")
    kept = F.aggregate(
        segments,
        F.expr("CAST(array() AS array<string>)"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)),
    )
    open_ended = F.element_at(segments, -1).isin(".", "..")
    return F.when(
        path.rlike(r"/\.\.?(/|$)"),
        F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(open_ended & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))),
    ).otherwise(path)


def resolve_href(base: Column, href: Column) -> Column:
    """The canonical URL that href means on the page base; '' if it isn't to be followed."""
    return let(F.regexp_replace(href, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), lambda ref: _resolve(base, ref))


def _resolve(base: Column, ref: Column) -> Column:
    skipped = ref.isNull() | ref.rlike("^(#|javascript:|mailto:|tel:)") | (ref == "")
    path, base_path = part(ref, 3), part(base, 3)
    rooted = lambda p: F.when(p.startswith("/") | (p == ""), p).otherwise(F.concat(F.lit("/"), p))
    folder = F.when(base_path == "", F.lit("/")).otherwise(F.regexp_replace(base_path, "[^/]*$", ""))
    origin = F.concat(part(base, 1), F.lit(":"), part(base, 2))
    target = (
        F.when(part(ref, 1) != "", F.concat(part(ref, 1), F.lit(":"), part(ref, 2), remove_dots(rooted(path)), part(ref, 4)))
        .when(part(ref, 2) != "", F.concat(part(base, 1), F.lit(":"), part(ref, 2), remove_dots(rooted(path)), part(ref, 4)))
        .when((path == "") & (part(ref, 4) == ""), F.concat(origin, base_path, part(base, 4)))
        .when(path == "", F.concat(origin, base_path, part(ref, 4)))
        .when(path.startswith("/"), F.concat(origin, remove_dots(path), part(ref, 4)))
        .otherwise(F.concat(origin, remove_dots(F.concat(folder, path)), part(ref, 4)))
    )
    found = F.when(skipped | ~_valid(ref), F.lit("")).otherwise(let(target, normalize_url))
    return let(found, lambda u: F.when(F.octet_length(u) <= MAX_BYTES, u).otherwise(F.lit("")))


def robots_path(url: Column) -> Column:
    """The path with its query, from the first / after ://; / if there is none."""
    found = F.regexp_extract(url, "(?s)://[^/]*(/.*)$", 1)
    return F.when(found == "", F.lit("/")).otherwise(found)
