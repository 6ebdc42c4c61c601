"""URL functions as column expressions. Nothing is fetched."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension and file type, the first that occurs in the path wins.
FILE_TYPES = (("pdf", "pdf"), ("docx", "docx"), ("doc", "doc"), ("xlsx", "xlsx"), ("xls", "xls"), ("zip", "zip"), ("rar", "rar"), ("ppt", "ppt"), ("pptx", "ppt"))
PRIORITY = {"document": 0, "detail": 1, "list": 2, "portal": 3}
#: Patterns of list pages.
LIST_PATTERNS = (r"/list\d*\.htm", r"/index[._]\d+\.(?:htm|shtml)", r"/page[._]\d+\.(?:htm|shtml)", r"/xwzx/[^/]+/\d+\.htm", r"/[^/]+/\d+\.htm", r"/index\.shtml")
#: Patterns of pages with one article, in lower-case URLs.
DETAIL_PATTERNS = (r"/info/", r"/content/", r"/article/", r"/system/.*\.shtml$", r"/c\d+a\d+/page\.htm", r"[?&]p=\d+", r"^(?!.*/list).*/\d{4}/\d{2,4}/.*\.htm$")
#: Whether a link leads to such a page, by the first pattern that is in the lower-case URL; lists come before.
LINK_RULES = (
    (r"/\d{4}/\d{2,4}/c\d+a\d+/page\.htm|[?&]p=\d+|[?&]page_id=\d+", True),
    (r"[?&]cat=\d+", False),
    (r"/(content|detail|info|article|read|view|page|show|display)/", True),
)
#: Paths of two parts or more, without doubled slashes, that speak for such a page if no rule decides.
DETAIL_PATHS = (r"^/.+/[^/]*\d{4}[^/]*$", r"^/.+/(?!index|list)[^/]*\.(htm|html|shtml)$", r"^/\d{4}/.")


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def part(url: Column, group: int) -> Column:
    """1 scheme, 2 network location, 3 path without parameters of its last segment, 4 query with its question mark."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#;]*)(?:;[^?#/]*)?(\?[^#]*)?", group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def domain(url: Column) -> Column:
    return part(url, 2)


def path(url: Column) -> Column:
    return part(url, 3)


def normalize(url: Column) -> Column:
    """Without fragment, /../ and trailing slashes; empty for null and empty."""
    url = F.replace(F.coalesce(url, F.lit("")), F.lit("/../"), F.lit("/"))
    query = F.when(F.length(part(url, 4)) > 1, part(url, 4)).otherwise("")
    whole = F.concat(scheme(url), F.lit("://"), domain(url), path(url), query)
    trimmed = F.when(whole.endswith("/") & (F.length(path(url)) > 1), F.regexp_replace(whole, "/+$", "")).otherwise(whole)
    return F.when(url == "", "").otherwise(trimmed)


def allowed(url: Column, domains: Iterable[str]) -> Column:
    host = F.lower(domain(url))
    return (F.coalesce(url, F.lit("")) != "") & any_of([F.lit(False), *((host == d) | host.endswith("." + d) for d in domains)])


def typed_path(url: Column) -> Column:
    lower = F.lower(F.coalesce(url, F.lit("")))
    return F.when(lower.contains("://"), F.lower(path(url))).otherwise(lower)


def is_attachment(url: Column) -> Column:
    return typed_path(url).rlike(r"\.(pdf|docx?|xlsx?|zip|rar|pptx?)")


def file_type(url: Column) -> Column:
    where, out = typed_path(url), F.lit("html")
    for ext, kind in reversed(FILE_TYPES):
        out = F.when(where.contains("." + ext), kind).otherwise(out)
    return out


def extension(url: Column, disposition: Column | None = None) -> Column:
    """The first known extension in the URL, else that of the file name in a Content-Disposition header, else .unknown."""
    lower = F.lower(F.coalesce(url, F.lit("")))
    out = F.lit(".unknown")
    if disposition is not None:
        name = F.regexp_extract(F.coalesce(disposition, F.lit("")), r"(?i)filename[^;=\n]*=[\"']?([^\"';\n]*)", 1)
        ext = F.regexp_extract(name, r"[^.](\.[^.]*)$", 1)
        out = F.when(ext != "", ext).otherwise(out)
    for ext, _ in reversed(FILE_TYPES):
        out = F.when(lower.contains("." + ext), "." + ext).otherwise(out)
    return out


def download_name(url: Column, disposition: Column | None = None) -> Column:
    return F.concat(F.substring(F.md5(url.cast("binary")), 1, 12), extension(url, disposition))


def priority(url: Column, page_role: Column, is_detail: Column) -> Column:
    """A given role's, else detail 1, attachment 0, other 2."""
    of_role = F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))
    guess = F.when(is_detail, 1).when(is_attachment(url), 0).otherwise(2)
    return F.when(page_role.isNull(), guess).otherwise(F.coalesce(F.try_element_at(of_role, page_role), F.lit(2)))


def is_list_url(url: Column) -> Column:
    lower = F.lower(url)
    return any_of(url.rlike("(?i)" + p) for p in LIST_PATTERNS) & ~lower.contains("/info/") & ~lower.contains("/system/")


def is_detail_url(url: Column) -> Column:
    return any_of(F.lower(url).rlike(p) for p in DETAIL_PATTERNS)


def is_portal_url(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "").rlike(r"/index\.(htm|html|shtml|php)$|/main\.htm$")


def role_by_url(url: Column) -> Column:
    """What the URL alone says: document, list, detail, portal, else detail if its path is two deep, else list."""
    lower = F.lower(url)
    deep = F.size(F.split(F.regexp_replace(path(url), "^/+|/+$", ""), "/")) >= 2
    return (
        F.when(lower.rlike(r"\.(pdf|doc|xls|zip|rar)"), "document")
        .when(is_list_url(url), "list")
        .when(is_detail_url(url), "detail")
        .when(is_portal_url(url), "portal")
        .when(deep, "detail")
        .otherwise("list")
    )


def is_detail_link(url: Column) -> Column:
    lower = F.lower(url)
    folders = F.concat(F.lit("/"), F.array_join(F.filter(F.split(F.lower(path(url)), "/"), lambda s: s != ""), "/"))
    out = any_of(folders.rlike(p) for p in DETAIL_PATHS)
    for pattern, verdict in reversed(LINK_RULES):
        out = F.when(lower.rlike(pattern), verdict).otherwise(out)
    return F.when(any_of(url.rlike("(?i)" + p) for p in LIST_PATTERNS), False).otherwise(out)


def site_name(url: Column, sources: Iterable[tuple[str, str]], unknown: str = "未知站点") -> Column:
    """sources: base URL and name; the first whose base URL stands in the URL wins."""
    out = F.lit(unknown)
    for base, name in reversed([*sources]):
        if base:
            out = F.when(F.contains(url, F.lit(base)), name).otherwise(out)
    return out


def base_href(url: Column) -> Column:
    """The directory of a page's URL, for <base href>."""
    p = path(url)
    folder = F.when(F.regexp_extract(p, r"([^/]*)$", 1).contains("."), F.regexp_replace(p, r"/?[^/]*$", "")).otherwise(p)
    return F.concat(scheme(url), F.lit("://"), domain(url), folder, F.lit("/"))


def with_base_href(html: Column, url: Column) -> Column:
    """html with <base> behind its first <head> tag, or wrapped if it has no head."""
    tag = F.concat(F.lit('<base href="'), base_href(url), F.lit('">'))
    at = F.regexp_instr(html, F.lit("(?i)<head[^>]*>"))
    found = F.regexp_extract(html, "(?i)(<head[^>]*>)", 1)
    end = at + F.length(found)
    inside = F.when(at > 0, F.concat(F.substr(html, F.lit(1), end - 1), F.lit("\n"), tag, F.substr(html, end))).otherwise(html)
    wrapped = F.concat(F.lit("<!DOCTYPE html>\n<html><head>"), tag, F.lit("</head><body>\n"), html, F.lit("\n</body></html>"))
    return F.when(F.coalesce(url, F.lit("")) == "", html).when(F.lower(html).contains("</head>"), inside).otherwise(wrapped)
