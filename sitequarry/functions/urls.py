"""URL functions: one Arrow function that normalises, native columns for everything on normalised URLs."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sitequarry.functions.text import js_trim

#: Parameter names with these beginnings only track a visitor.
TRACKING = re.compile(r"(utm_|fbclid|gclid|mc_[ce]id|ref|source|hsa_)", re.IGNORECASE)
#: Endings of files that aren't pages.
NON_PAGES = "png jpg jpeg gif svg webp avif ico bmp css js mjs map json xml rss atom pdf zip gz tar dmg exe pkg woff woff2 ttf mp4 webm mp3 wav mov csv txt".split()

_PORTS = {"http": 80, "https": 443}
_BAD_HOST = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")


def _keep(text: str, extra: str) -> str:
    """Percent-encodes what the URL standard encodes in this place; existing escapes stay."""
    return "".join(c if "\x20" < c < "\x7f" and c not in extra else quote(c, safe="", errors="replace") for c in text)


def _host(raw: str) -> str | None:
    try:
        name = unquote_to_bytes(raw).decode("utf-8").lower()
        if not name.isascii():
            name = name.encode("idna").decode("ascii")
    except UnicodeError:
        return None
    return None if not name or _BAD_HOST.search(name) else name


def _path(raw: str) -> str:
    out: list[str] = []
    parts = raw.split("/")[1:] if raw.startswith("/") else raw.split("/")
    for k, part in enumerate(parts):
        dots = part.lower().replace("%2e", ".")
        last = k == len(parts) - 1
        if dots == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif dots == ".":
            if last:
                out.append("")
        else:
            out.append(_keep(part, '"#<>?`{}'))
    return "/" + "/".join(out)


def _query(raw: str) -> str:
    pairs = []
    for piece in raw.split("&"):
        if not piece:
            continue
        name, _, value = piece.partition("=")
        read = lambda s: unquote_to_bytes(s.replace("+", " ")).decode("utf-8", "replace")
        pairs.append((read(name), read(value)))
    pairs = [p for p in pairs if not TRACKING.match(p[0])]
    pairs.sort(key=lambda p: p[0].encode("utf-16-be", "surrogatepass"))
    write = lambda s: quote(s, safe="*-._ ", errors="replace").replace("~", "%7E").replace(" ", "+")
    return "&".join(f"{write(n)}={write(v)}" for n, v in pairs)


def normalize(url: str | None, base: str | None = None) -> str | None:
    """Normal form of an http(s) URL, resolved against a normal ``base``; None where it isn't one.

    Fragment, user and tracking parameters are dropped, parameters sorted by name, trailing slashes of a longer path and
    one leading ``www.`` removed. Null gives None, a blank one the base itself.
    """
    if url is None:
        return None
    text = re.sub(r"[\t\n\r]", "", url.strip("".join(map(chr, range(33)))))
    text = text.split("#", 1)[0]
    match = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):", text)
    if match:
        scheme, rest = match[1].lower(), text[match.end() :]
        if scheme not in _PORTS:
            return None
        body, _, query = rest.partition("?")
        body = body.replace("\\", "/").lstrip("/")
    else:
        if base is None:
            return None
        own = re.match(r"(https?)://([^/?]*)([^?]*)(?:\?(.*))?$", base)
        if not own:
            return None
        scheme, (left, mark, query) = own[1], text.partition("?")
        left = left.replace("\\", "/")
        if left.startswith("//"):
            body = left.lstrip("/")
        elif left.startswith("/"):
            body = own[2] + left
        elif left:
            body = own[2] + own[3].rsplit("/", 1)[0] + "/" + left
        else:
            body = own[2] + own[3]
            query = query if mark else own[4] or ""
    authority, slash, path = body.partition("/")
    authority = authority.rsplit("@", 1)[-1]
    name, colon, port = authority.partition(":") if not authority.startswith("[") else (authority, "", "")
    host = _host(name)
    if host is None or (port and (not port.isascii() or not port.isdigit() or int(port) > 65535)):
        return None
    path = _path(slash + path)
    if len(path) > 1 and path.endswith("/"):
        path = path.rstrip("/") or "/"
    host = host[4:] if host.startswith("www.") and len(host) > 4 else host
    port = "" if not port or int(port) == _PORTS[scheme] else f":{int(port)}"
    tail = _query(query)
    return f"{scheme}://{host}{port}{path}" + (f"?{tail}" if tail else "")


@F.pandas_udf(StringType())
def normalize_url(url: pd.Series) -> pd.Series:
    """Column form of :func:`normalize` without a base."""
    return url.map(normalize, na_action="ignore").astype(object)


@F.pandas_udf(StringType())
def resolve_url(url: pd.Series, base: pd.Series) -> pd.Series:
    """Column form of :func:`normalize` with a base; blank and null references give null (they are no links)."""
    return pd.Series([normalize(u, b) if u and u.strip() else None for u, b in zip(url, base, strict=True)], dtype=object)


# Deterministic as they are, they are declared not to be: else a filter on their result is pushed below it and runs them twice.
normalize_url, resolve_url = normalize_url.asNondeterministic(), resolve_url.asNondeterministic()


def host(url: Column) -> Column:
    """Host of a normalised URL, without a leading ``www.``."""
    return F.regexp_extract(url, r"^https?://(?:www\.)?([^/?#:]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1), "^$", "/")


def path_and_query(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^https?://[^/?#]*([^#]*)", 1), r"^(?!/)", "/")


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def is_likely_page(url: Column) -> Column:
    """False for files: the ending runs from the last dot of the whole path."""
    ending = F.lower(F.regexp_extract(path(url), r"\.([^.]*)$", 1))
    return ~ending.isin(NON_PAGES)


def is_same_site(url: Column, other: Column) -> Column:
    """Hosts equal but for a leading ``www.``; false where either has none."""
    return F.coalesce((host(url) == host(other)) & (host(url) != ""), F.lit(False))


def base_path(url: Column) -> Column:
    """The directory an entry URL stands for."""
    whole, parts = path(url), segments(url)
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    parent = F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/"))
    return F.when(whole.endswith("/"), whole).when(F.size(parts) == 0, "/").when(last.contains("."), parent).otherwise(F.concat(whole, F.lit("/")))


def in_scope(url: Column, entry: Column, scope_to_path: Column) -> Column:
    """Same site, and below the entry's directory where that is asked for (a plain prefix test)."""
    base = base_path(entry)
    return is_same_site(url, entry) & (~scope_to_path | (base == "/") | F.startswith(path(url), F.regexp_replace(base, "/$", "")))


def ensure_url(text: Column) -> Column:
    """Trimmed, with a scheme."""
    trimmed = js_trim(text)
    return F.when(trimmed.rlike(r"(?i)^https?://"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))


def _capitals(words: Column) -> Column:
    """Upper case for each letter that begins an ASCII word."""
    letters = F.split(words, "")
    marked = F.transform(letters, lambda c, i: F.when(c.rlike(r"^[A-Za-z0-9_]$") & ((i == 0) | ~F.coalesce(F.get(letters, i - 1), F.lit(" ")).rlike(r"^[A-Za-z0-9_]$")), F.upper(c)).otherwise(c))
    return F.array_join(marked, "")


def label(segment: Column) -> Column:
    """Readable label of a path segment."""
    return _capitals(F.regexp_replace(F.regexp_replace(segment, r"(?i)\.[a-z]+$", ""), "[-_]+", " "))


def title_from_path(url: Column) -> Column:
    return label(F.coalesce(F.try_element_at(segments(url), F.lit(-1)), F.lit("Home")))


def markdown_targets(header: Column) -> Column:
    """Targets of the parts of a Link header that are alternates in Markdown, in order; null for a null header."""
    parts = F.filter(F.split(header, ","), lambda p: p.rlike(r"""(?i)rel="?alternate"?""") & p.rlike(r"""(?i)type="?text/markdown"?"""))
    return F.filter(F.transform(parts, lambda p: F.regexp_extract(p, r"<([^>]+)>", 1)), lambda t: t != "")


def markdown_from_header(header: Column) -> Column:
    """The first of :func:`markdown_targets`, not resolved; null without one."""
    return F.get(markdown_targets(header), F.lit(0))


@F.pandas_udf(StringType())
def resolve_first(urls: pd.Series, base: pd.Series) -> pd.Series:
    """The first of several references that resolves against a base; null where none does."""
    return pd.Series([next((r for u in (us if us is not None else ()) if u and u.strip() and (r := normalize(u, b))), None) for us, b in zip(urls, base, strict=True)], dtype=object)
