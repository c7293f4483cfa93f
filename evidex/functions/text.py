"""Column functions over texts and URLs: normalization, hashes, scope, tokens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track, as a pattern.
TRACKING = r"^(utm_.*|fbclid|gclid|ref)="
TOKEN = r"[A-Za-z0-9][A-Za-z0-9_.+#-]*"


def normalized(text: Column | str) -> Column:
    """Line ends as LF, runs of blanks as one space, no trailing blanks, at most one empty line, stripped."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r" +\n", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def content_hash(text: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(normalized(text), 256))


def fingerprint(text: Column | str) -> Column:
    """Hash of the ASCII letters and digits alone; null where a text has none, so that such texts don't meet."""
    kept = F.regexp_replace(F.lower(text), "[^0-9a-z]+", "")
    return F.when(kept != "", F.sha2(kept, 256))


def statement(text: Column | str) -> Column:
    """White space collapsed, lower-cased, without trailing dots."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^ | $", "")), r"\.+$", "")


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column | str) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column | str) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def canonical_url(url: Column | str) -> Column:
    """An absolute URL without fragment and tracking parameters; other schemes become empty."""
    kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    place = F.when(path(url) == "", "/").otherwise(path(url))
    return F.when(scheme(url).isin("http", "https"), F.concat(scheme(url), F.lit("://"), host(url), place, tail)).otherwise("")


def canonical_link(page: Column | str) -> Column:
    """The page's first rel=canonical link, else its og:url, canonicalized; null where it declares neither."""
    found = [
        F.regexp_extract(page, r"""(?is)<link\b(?=[^>]*\brel=["']?canonical\b)[^>]*\bhref=["']?([^"'\s>]+)""", 1),
        F.regexp_extract(page, r"""(?is)<meta\b(?=[^>]*\bproperty=["']?og:url\b)[^>]*\bcontent=["']?([^"'\s>]+)""", 1),
    ]
    return F.coalesce(*(F.when(canonical_url(f) != "", canonical_url(f)) for f in found))


#: Elements without main text, elements that end a line, and character references that are read.
DROPPED = "script style nav header footer aside form noscript template svg".split()
BLOCKS = "p div section article ul ol li table tr h1 h2 h3 h4 h5 h6 br pre blockquote main td th dl dt dd figure figcaption".split()
REFERENCES = {"nbsp": " ", "middot": "·", "copy": "©", "quot": '"', "lt": "<", "gt": ">", "amp": "&"}


def main_text(page: Column | str) -> Column:
    """A page's article, else its body, without menus, forms, scripts and markup, a line per block: a plain reading by
    patterns, for pages that are well formed. An unclosed element or comment that is left out takes the rest of the page;
    no pattern reads a place twice from another start, so any page takes time in proportion to its length."""
    t = F.col(page) if isinstance(page, str) else page
    t = F.regexp_replace(t, r"(?s)<!--.*?(?:-->|\z)", " ")
    for tag in DROPPED:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?(?:</{tag}\b[^<>]*>|\z)", " ")

    def inner(tag: str) -> Column:  # from the first opening to the last closing
        rest = F.regexp_extract(t, rf"(?is)^.*?<{tag}\b[^<>]*>(.*)$", 1)
        return F.regexp_extract(rest, rf"(?is)^(.*)</{tag}\b", 1)

    t = F.coalesce(*(F.when(inner(tag) != "", inner(tag)) for tag in ("article", "body")), t)
    t = F.regexp_replace(t, rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^<>]*>", "\n")
    t = F.regexp_replace(t, "<[^<>]*>", "")
    for name, char in REFERENCES.items():
        t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n[ \n]*", "\n")
    return F.trim(F.regexp_replace(t, r"^\s+|\s+$", ""))


def reader(content_type: Column, url: Column) -> Column:
    """pdf by type or by the path's ending, else html."""
    return F.when(F.lower(content_type).startswith("application/pdf") | F.lower(path(url)).endswith(".pdf"), "pdf").otherwise("html")


def public_address(host: Column) -> Column:
    """Whether an address may be fetched; null for what is no address. Numbers, hexadecimal and octal parts are read as
    systems read them; addresses of version 6 that hold one of version 4 are judged by that."""

    @F.pandas_udf("boolean")
    def run(hosts: pd.Series) -> pd.Series:
        return hosts.map(lambda h: _public(h or ""), na_action=None)

    return run(host)


def _public(host: str) -> bool | None:
    import ipaddress

    try:
        address = ipaddress.ip_address(host.strip("[]")) if ":" in host else ipaddress.ip_address(_number(host))
    except ValueError:
        return None
    if address.version == 6:
        inner = address.ipv4_mapped or address.sixtofour or (address.teredo[1] if address.teredo else None)
        address = inner or address
    shared = address.version == 4 and address in ipaddress.ip_network("100.64.0.0/10")
    return address.is_global and not (shared or address.is_multicast or address.is_reserved)


def _number(host: str) -> int:
    """An address of version 4 in one to four parts, each decimal, octal or hexadecimal; the last fills what is left."""
    parts = host.split(".")
    values = [int(p, 16 if p[:2].lower() == "0x" else 8 if len(p) > 1 and p[0] == "0" else 10) for p in parts]
    *first, last = values
    if len(parts) > 4 or any(not 0 <= v < 256 for v in first) or not 0 <= last < 256 ** (5 - len(parts)):
        raise ValueError(host)
    return sum(v << 8 * (3 - i) for i, v in enumerate(first)) + last


def surface(text: Column, stem: Column) -> Column:
    """The first word of a text that begins with a stem, as written; null where none does."""
    pattern = F.concat(F.lit(r"(?i)(?:^|[^\p{L}])("), F.regexp_replace(stem, r"([\\.+*?()\[\]{}|^$-])", r"\\$1"), F.lit(r"[\w-]*)"))
    found = F.call_function("regexp_extract", text, pattern, F.lit(1))
    return F.when((stem != "") & (found != ""), found)


def url_key(url: Column | str) -> Column:
    """Host and path for comparison: lower-cased, no trailing slash, no query."""
    return F.lower(F.concat(host(url), F.regexp_replace(path(url), "/+$", "")))


def bare_host(url: Column | str) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def under(name: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or lies below one."""
    found = F.lit(False)
    for d in domains:
        found = found | (name == d) | name.endswith(f".{d}")
    return found


def in_scope(url: Column | str, seed_host: Column | str, deny: str, allow: str | None, prefix: str) -> Column:
    """Same host, not denied, and allowed by pattern or else under the seed's folder."""
    kept = F.col(url).rlike(allow) if allow else path(url).startswith(prefix)
    return (host(url) == seed_host) & ~F.col(url).rlike(deny) & kept


def tokens(text: Column | str) -> Column:
    """Word-like tokens, stripped of dots at both ends."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), lambda t: F.regexp_replace(t, r"^\.+|\.+$", ""))


def words(text: Column | str) -> Column:
    """Lower-cased ASCII words, the plain lexemes of the index."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def boilerplate(text: Column | str) -> Column:
    """No line with text, or at least eight lines over four fifths of which are shorter than 40 characters."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    short = F.size(F.filter(lines, lambda x: F.length(F.trim(x)) < 40))
    return (F.size(lines) == 0) | ((F.size(lines) >= 8) & (short > 0.8 * F.size(lines)))


def predicate_core(predicate: Column | str) -> tuple[Column, Column]:
    """(core, negated): without leading auxiliary and negation, the first word crudely stemmed."""
    p = statement(predicate)
    negation = r"^(?:(is|are|was|were|does|do|did|can|could|will|would|should|must|has|have|had) )?(not|never|cannot|no longer) "
    bare = r"^(does|do|did|can|could|will|would|should|must|has|have|had) "
    padded = F.concat(p, F.lit(" "))
    negated = padded.rlike(negation)
    rest = F.trim(F.when(negated, F.when(F.trim(F.regexp_replace(padded, negation, "")) == "", F.regexp_extract(padded, r"^(\w+)", 1)).otherwise(F.regexp_replace(padded, negation, ""))).otherwise(F.regexp_replace(padded, bare, "")))
    first = F.regexp_extract(rest, r"^(\S*)", 1)
    tail = F.substr(rest, F.length(first) + 1)
    n = F.length(first)
    stem = (
        F.when((n > 4) & first.rlike("(ies|ied)$"), F.concat(F.substring(first, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & first.rlike("(sses|shes|ches|xes|zes)$"), F.substring(first, F.lit(1), n - 2))
        .when((n > 4) & first.rlike("[^s]s$"), F.substring(first, F.lit(1), n - 1))
        .when((n > 4) & first.rlike("ed$"), F.substring(first, F.lit(1), n - 2))
        .otherwise(first)
    )
    return F.concat(stem, tail), negated
