"""What a fetch's headers and errors say, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3600

# Parts of error messages, in the order in which they count.
MESSAGES = (
    ("dns_nxdomain", ("no TYPE=A record found", "failed to resolve DNS", "no such host", "no suitable IP address")),
    ("tls_error", ("tls:",)),
    ("tls_cert", ("certificate",)),
    ("eof", ("EOF",)),
    ("too_many_redirects", ("too many redirects",)),
    ("conn_reset", ("connection reset",)),
    ("conn_refused", ("connection refused",)),
)
#: Kinds that a fetcher states itself; they count before any message.
KINDS = (
    "timeout", "cancelled", "dns_timeout", "dns_nxdomain", "dns_error", "conn_refused", "conn_reset",
    "conn_aborted", "tcp_timeout", "net_unreachable", "host_unreachable",
)
TLS_VERSIONS = {0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"}


def short_content_type(value: Column) -> Column:
    """What is before the semicolon, trimmed, in lower case; unknown only where there is no header at all."""
    plain = F.regexp_replace(F.lower(F.split_part(value, F.lit(";"), F.lit(1))), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.when(value.isNull() | (value == ""), F.lit("unknown")).otherwise(plain)


def is_html(content_type: Column) -> Column:
    return content_type.contains("text/html") | content_type.contains("application/xhtml")


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header: a positive number or an HTTP date, an hour at most; else 0."""
    seconds = F.try_to_number(F.when(value.rlike("^[+-]?[0-9]{1,18}$"), F.regexp_replace(value, "^[+]", "")), F.lit("S999999999999999999"))
    until = F.unix_timestamp(F.try_to_timestamp(value.substr(6, 20), F.lit("dd MMM yyyy HH:mm:ss"))) - F.unix_timestamp(now)
    dated = F.when(value.rlike("^[A-Z][a-z]{2}, [0-9]{2} [A-Z][a-z]{2} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2} GMT$"), until)
    wait = F.when(seconds > 0, seconds.cast("bigint")).otherwise(F.greatest(dated, F.lit(0)))
    return F.coalesce(F.least(wait, F.lit(HOUR)), F.lit(0)).cast("bigint")


def tls_version_name(version: Column) -> Column:
    named = F.create_map(*(F.lit(x) for pair in TLS_VERSIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(named, version), F.lit("unknown"))


def classify_error(kind: Column, message: Column) -> Column:
    """The cause of a network error: its stated kind, else what its message holds."""
    out = F.when(kind.isNull() & message.isNull(), F.lit("unknown")).when(kind.isin(*KINDS), kind)
    for name, parts in MESSAGES:
        for text in parts:
            out = out.when(message.contains(text), F.lit(name))
    return out.otherwise(F.lit("other"))


def encode_wire(url: Column, depth: Column) -> Column:
    return F.concat_ws("\t", depth.cast("string"), url)


def decode_wire(wire: Column) -> Column:
    """struct(url, depth): the number before the first tab, if there is one; else the whole and 0."""
    depth = F.when(wire.rlike("^[+-]?[0-9]{1,9}\t"), F.regexp_extract(wire, "^([+-]?[0-9]+)\t", 1).cast("int"))
    url = F.when(depth.isNull(), wire).otherwise(F.regexp_replace(wire, "^[^\t]*\t", ""))
    return F.struct(url.alias("url"), F.coalesce(depth, F.lit(0)).alias("depth"))
