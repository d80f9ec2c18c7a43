"""Web pages: text and bibliographic meta tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.text import any_doi, group, strip, sub

#: Characters of a page in which tags are looked for.
HEAD = 200_000


def page_text(html: Column) -> Column:
    """Text of a page: scripts and styles go, ends of blocks become line ends, other tags blanks; five entities are decoded."""
    text = sub(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    text = sub(text, r"(?i)<br\s*/?>|</p>|</div>|</li>|</h[1-6]>|</tr>", "\n")
    text = sub(text, "<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return strip(sub(sub(text, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def meta_tag(head: Column, name: str) -> Column:
    """Content of the first meta tag of this name or property, whichever of the attributes stands first."""
    named = rf"""(?:name|property)=["']{name}["']"""
    content = r"""content=["']([^"']+)"""
    first = group(head, rf"(?i)<meta[^>]+{named}[^>]+{content}", 1)
    return strip(F.when(first != "", first).otherwise(group(head, rf"""(?i)<meta[^>]+{content}["'][^>]+{named}""", 1)))


def page_record(pages: DataFrame, html_column: str = "html", url_column: str = "url") -> DataFrame:
    """pages with the fields of a bibliographic entry from meta tags: type, lang, title, authors (10 at most), container, volume, issue,
    publisher, pages, year, doi. Without tags the title is the page's own, 200 characters of it, and the type web."""
    head = F.substring(F.coalesce(F.col(html_column), F.lit("")), 1, HEAD)
    own = sub(group(head, r"(?is)<title[^>]*>(.*?)</title>", 1), r"(?U)\s+", " ")
    title = F.coalesce(F.nullif(meta_tag(head, "citation_title"), F.lit("")), F.nullif(meta_tag(head, "og:title"), F.lit("")), F.substring(strip(own), 1, 200))
    authors = F.slice(F.regexp_extract_all(head, F.lit(r"""(?i)<meta[^>]+name=["']citation_author["'][^>]+content=["']([^"']+)"""), F.lit(1)), 1, 10)
    first, last = meta_tag(head, "citation_firstpage"), meta_tag(head, "citation_lastpage")
    date = F.coalesce(F.nullif(meta_tag(head, "citation_publication_date"), F.lit("")), meta_tag(head, "citation_date"))
    fields = {name: meta_tag(head, tag) for name, tag in (("container", "citation_journal_title"), ("volume", "citation_volume"), ("issue", "citation_issue"), ("publisher", "citation_publisher"))}
    rows = pages.withColumns(fields | {"title": title, "authors": authors, "doi": any_doi(meta_tag(head, "citation_doi")), "year": group(date, r"^\d{4}")})
    rows = rows.withColumn("pages", F.when((first != "") & (last != ""), F.concat(first, F.lit("-"), last)).otherwise(first))
    rows = rows.withColumn("type", F.when((F.col("doi") != "") | (F.col("container") != ""), "journal").otherwise("web"))
    return rows.withColumn("lang", F.when(F.col("title").rlike("[가-힣]"), "ko").otherwise("west"))
