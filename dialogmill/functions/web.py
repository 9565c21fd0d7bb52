"""HTML and URL functions on columns."""

from __future__ import annotations

from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialogmill.functions import text as t

# fixed values: the patterns of cleaning, in order; what each becomes
BLOCKS = r"(?is)<(script|style|noscript).*?>.*?</\1>"
BLOCK_TAGS = ("script", "style", "noscript")
TAGS = ((r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>|</li>|</h\d>|</section>|</article>", "\n"), (r"(?s)<[^>]+>", " "))
#: The same in fewer passes: what becomes a line end, and other tags.
LINE_ENDS, ANY_TAG = r"(?i)<(?:br\s*/?|/(?:p|li|h\d|section|article))>", TAGS[-1][0]
SPACES = r"(?U)[^\S\r\n]+"

#: Frequent entities, which need no table; the ampersand's is not among them, as it may begin another one.
PLAIN_ENTITIES = {"&nbsp;": "\xa0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'"}
#: Names with their semicolon, and those that the standard also reads without one.
NAMED = {name: text for name, text in sorted(html5.items()) if name.endswith(";")}
BARE = {name: text for name, text in sorted(html5.items()) if not name.endswith(";")}
#: Numbers that the standard reads as Windows' characters, or as nothing.
WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)} | {0: "\ufffd", 13: "\r"}
_CONTROLS = [*range(1, 9), 11, *range(14, 32), 127]


def _table(entries: dict) -> Column:
    """A constant map from one string, which the optimizer folds."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in entries.items())), F.lit("\x01"), F.lit("\x02"))


def _character(digits: Column, base: int) -> Column:
    """The character of a number in a text, as the standard reads it."""
    n = F.when(F.length(F.regexp_replace(digits, "^0+", "")) > 9, F.lit(1 << 30)).otherwise(F.conv(F.regexp_replace(digits, "^0+(?=.)", ""), base, 10).cast("long"))

    def of(n: Column) -> Column:
        outside = n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        nothing = n.isin(_CONTROLS) | n.between(0xFDD0, 0xFDEF) | (n % 0x10000 >= 0xFFFE)
        safe = F.when(outside | nothing, F.lit(32)).otherwise(n)
        return F.when(n.isin([*WINDOWS]), F.try_element_at(_table(WINDOWS), n.cast("string"))).when(outside, "\ufffd").when(nothing, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32"))

    return t.let(n, of)


def _reference(part: Column) -> Column:
    """What follows an ampersand, with the reference at its start decoded."""
    def rest(pattern: str) -> Column:
        return F.regexp_replace(part, pattern, "")

    decimal, hexadecimal = r"^#([0-9]+);?", r"^#[xX]([0-9a-fA-F]+);?"
    named = F.regexp_extract(part, r"^([^\t\n\f <&#;]{1,32};)", 1)
    full = F.when(named != "", F.try_element_at(_table(NAMED), named))
    bare = "^(" + "|".join(sorted(BARE, key=lambda x: (-len(x), x))) + ")"
    start = F.regexp_extract(part, bare, 1)
    return (
        F.when(part.rlike(decimal), F.concat(_character(F.regexp_extract(part, decimal, 1), 10), rest(decimal)))
        .when(part.rlike(hexadecimal), F.concat(_character(F.regexp_extract(part, hexadecimal, 1), 16), rest(hexadecimal)))
        .when(full.isNotNull(), F.concat(full, F.substring(part, F.length(named) + 1, F.length(part))))
        .when(start != "", F.concat(F.try_element_at(_table(BARE), start), F.substring(part, F.length(start) + 1, F.length(part))))
        .otherwise(F.concat(F.lit("&"), part))
    )


def unescape(c: Column) -> Column:
    """Character references decoded once, all names and numbers of the standard."""
    plain = reduce(lambda a, kv: F.replace(a, F.lit(kv[0]), F.lit(kv[1])), PLAIN_ENTITIES.items(), c)

    def each(text: Column) -> Column:
        parts = F.split(text, "&", -1)
        return F.when(~text.contains("&"), text).otherwise(F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), _reference), "")))

    return t.let(plain, each)


def html_text(c: Column) -> Column:
    """The visible text: no scripts, styles and tags; breaks and ends of blocks become line ends."""
    bare = reduce(lambda a, step: F.regexp_replace(a, *step), [(BLOCKS, " "), (LINE_ENDS, "\n"), (ANY_TAG, " ")], F.coalesce(c, F.lit("")))
    return t.squeezed(F.regexp_replace(unescape(bare), SPACES, " "))


# fixed values: the patterns of a title and of a link's target
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HREF = r"""(?i)href=["']([^"']+)["']"""


def title(html: Column, url: Column) -> Column:
    found = F.substring(html_text(F.regexp_extract(F.coalesce(html, F.lit("")), TITLE, 1)), 1, 180)
    return F.when(found != "", found).when(authority(url) != "", authority(url)).otherwise("web")


def authority(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def host_name(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(t.strip(F.coalesce(host, F.lit("")))), r"\.+$", ""), r"^www\.", "")


def host(url: Column) -> Column:
    return host_name(authority(url))


def canonical(url: Column) -> Column:
    """Scheme, host and path without query and fragment; empty for other schemes than http and https."""
    one = F.regexp_replace(F.when(path(url) == "", "/").otherwise(path(url)), "/+", "/")
    one = F.when(one == "/", one).otherwise(F.regexp_replace(one, "/+$", ""))
    return F.when(scheme(url).isin("http", "https") & (host(url) != ""), F.concat(scheme(url), F.lit("://"), host(url), one)).otherwise("")


def matches_domain(host_col: Column, domains: list[str], empty: bool = True) -> Column:
    """The host is one of the domains or below one; of an empty list ``empty`` holds: as an allow list it lets everything through."""
    return reduce(lambda a, b: a | b, [(host_col == d) | host_col.endswith("." + d) for d in domains], F.lit(False)) if domains else F.lit(empty)


def usable_patterns(patterns: list[str]) -> tuple[list[str], list[str]]:
    """(patterns that the regular-expression engine takes, a warning for each other one)."""
    from pyspark import SparkContext

    engine = SparkContext._active_spark_context._jvm.java.util.regex.Pattern
    good, warnings = [], []
    for p in patterns:
        try:
            engine.compile(p)
            good.append(p)
        except Exception as e:  # noqa: BLE001
            reason = str(getattr(e, "java_exception", e)).splitlines()[0]
            warnings.append(f"invalid_pattern:{p}:{reason}")
    return good, warnings


def excluded(url: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns is found, in whatever case; those that are no regular expressions count for nothing."""
    good = usable_patterns(patterns)[0]
    return url.rlike("(?i)" + "|".join(f"({p})" for p in good)) if good else F.lit(False)


def links(html: Column) -> Column:
    """The targets of the page's links, in order, as they stand."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(HREF), F.lit(1))
    return F.filter(F.transform(found, lambda x: t.strip(unescape(x))), lambda x: (x != "") & ~x.startswith("#"))


def absolute(href: Column, base: Column) -> Column:
    folder = F.regexp_extract(F.when(path(base) == "", "/").otherwise(path(base)), r"^(.*/)", 1)
    root = F.concat(scheme(base), F.lit("://"), host(base))
    return F.when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href)).when(href.startswith("http://") | href.startswith("https://"), href).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(root, folder, href))


def redirect_target(href: Column) -> Column:
    """The address inside a search engine's redirect link."""
    h = unescape(href)
    inner = F.try_url_decode(F.regexp_extract(h, r"[?&]uddg=([^&#]*)", 1))
    return F.when(h.startswith("//"), F.concat(F.lit("https:"), h)).when(h.rlike("^https?://"), h).when(F.coalesce(inner, F.lit("")) != "", inner).otherwise(h)
