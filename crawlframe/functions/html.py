"""Links of HTML pages: a native fast path and an exact tokenizer as a UDTF."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlframe.functions.binding import let

# Character references by name that URLs and texts mostly hold.
_NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\u00a0"}
_SKIPPED = r"(?is)<!--.*?-->|<(script|style|title|textarea)\b[^>]*>.*?</\1\s*>"
_ANCHOR = r"""(?is)<a(?=[\s/])(?:[^>"']|"[^"]*"|'[^']*')*>"""
_ATTRIBUTE = r"""(?is)[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*))?"""
_HREF = r"(?is)^href\s*=\s*(.*)$"


def unescape(text: Column) -> Column:
    """Character references: amp, lt, gt, quot, apos and nbsp by name, any other by decimal or hexadecimal number."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};|&(?:amp|lt|gt|quot|apos|nbsp);|[^&]+|&"), F.lit(0))
    named = F.create_map(*(F.lit(x) for pair in _NAMED.items() for x in pair))

    def char(code: Column) -> Column:
        """A code point in UTF-8; what is none is the replacement character."""
        wide = lambda n: F.lpad(F.hex(n), 2, "0")
        tail = lambda shift: wide(F.shiftright(code, shift).bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80)))
        none = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        digits = (
            F.when(none, F.lit("EFBFBD"))
            .when(code < 0x80, wide(code))
            .when(code < 0x800, F.concat(wide(F.shiftright(code, 6).bitwiseOR(F.lit(0xC0))), tail(0)))
            .when(code < 0x10000, F.concat(wide(F.shiftright(code, 12).bitwiseOR(F.lit(0xE0))), tail(6), tail(0)))
            .otherwise(F.concat(wide(F.shiftright(code, 18).bitwiseOR(F.lit(0xF0))), tail(12), tail(6), tail(0)))
        )
        return F.decode(F.unhex(digits), "utf-8")

    def one(part: Column) -> Column:
        number = F.when(part.rlike("^&#[xX]"), F.conv(F.regexp_extract(part, "^&#[xX]([0-9A-Fa-f]+);$", 1), 16, 10)).otherwise(
            F.regexp_extract(part, "^&#([0-9]+);$", 1)
        )
        return F.when(part.rlike("^&#.*;$"), let(number.try_cast("int"), char)).otherwise(F.coalesce(F.try_element_at(named, part), part))

    return F.when(text.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def hrefs(html: Column) -> Column:
    """The href values of all a tags, in their order. Comments and raw-text elements hold none."""
    tags = F.regexp_extract_all(F.regexp_replace(html, _SKIPPED, " "), F.lit(_ANCHOR), F.lit(0))
    attributes = F.flatten(F.transform(tags, lambda t: F.regexp_extract_all(F.substring(t, 3, 1 << 30), F.lit(_ATTRIBUTE), F.lit(0))))
    values = F.transform(F.filter(attributes, lambda a: a.rlike(_HREF)), lambda a: F.regexp_extract(a, _HREF, 1))
    return F.transform(values, lambda v: unescape(F.when(v.rlike("^[\"']"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)))


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.found += [value or "" for name, value in attrs if name == "href"]

    handle_startendtag = handle_starttag


@F.udtf(returnType="pos int, href string")
class ExactLinks:
    """Rows (pos, href) by a tokenizer: for pages that the regular expressions would misread."""

    def eval(self, html: str):
        parser = _Links()
        parser.feed(html or "")
        yield from enumerate(parser.found)
