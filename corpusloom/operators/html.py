"""HTML extraction: title, description, sections, full text and the scraped-document record."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from corpusloom.functions import text as T
from corpusloom.functions import urls as U
from corpusloom.operators import chunk
from corpusloom.operators.clean import clean

# Elements that carry no content.
DROP_TAGS = frozenset(("script", "style", "meta", "noscript", "nav", "footer", "form", "button", "input", "header"))
DROP_CLASSES = frozenset(("sidebar", "menu", "navbar"))
HEADINGS, BLOCKS, ROOTS = ("h1", "h2", "h3"), ("p", "ul", "li"), ("main", "article", "section")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Tree(HTMLParser):
    """Collects the text spans of the elements that count; a stack, no tree of objects."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []  # tag, dropped from here on, number of its span or -1
        self.dropped = 0
        self.root_depth: int | None = None
        self.root_done = False
        self.spans: list[list] = []  # tag, texts
        self.open: list[int] = []
        self.all: list[str] = []
        self.title: list[str] | None = None
        self.og = self.description = ""
        self.links: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "meta":
            if a.get("property") == "og:title" and not self.og:
                self.og = (a.get("content") or "").strip()
            if a.get("name") == "description" and not self.description:
                self.description = (a.get("content") or "").strip()
        if tag == "a" and a.get("href") is not None:
            self.links.append(a["href"])
        if tag == "title" and self.title is None:
            self.title = []
        if tag in VOID:
            return
        drop = tag in DROP_TAGS or bool(DROP_CLASSES & set((a.get("class") or "").split()))
        span = -1
        if not self.dropped and not drop:
            if self.root_depth is None and not self.root_done and tag in ROOTS:
                self.root_depth = len(self.stack)
            elif self.root_depth is not None and tag in HEADINGS + BLOCKS:
                span = len(self.spans)
                self.spans.append([tag, []])
                self.open.append(span)
        self.dropped += drop
        self.stack.append((tag, drop, span))

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _, _ in self.stack):
            return
        while self.stack:
            t, drop, span = self.stack.pop()
            self.dropped -= drop
            if span >= 0:
                self.open.remove(span)
            if self.root_depth is not None and len(self.stack) <= self.root_depth:
                self.root_depth, self.root_done = None, True
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "title" and self.title is not None:
            self.title.append(data)
        if not self.dropped:
            self.all.append(data)
            for i in self.open:
                self.spans[i][1].append(data)


def parse(html: str | None) -> dict:
    """Title, description, sections in order, whole text and link targets of one page; null is an empty page."""
    p = _Tree()
    p.feed(html or "")
    p.close()
    sections: dict[str, str] = {}
    name, held = "introduction", []
    for tag, parts in p.spans:
        t = "".join(parts).strip()
        if tag in HEADINGS:
            if held:
                sections[name] = " ".join(held).strip()
                held = []
            name = t[:100]
        elif t:
            held.append(t)
    if held:
        sections[name] = " ".join(held).strip()
    return {
        "title": p.og or "".join(p.title or []).strip(),
        "description": p.description,
        "sections": [{"section": k, "content": v} for k, v in sections.items()],
        "body": " ".join(p.all),
        "links": p.links,
    }


_SECTION = StructType([StructField("section", StringType()), StructField("content", StringType())])
PARSED = StructType([
    StructField("title", StringType()), StructField("description", StringType()), StructField("sections", ArrayType(_SECTION)),
    StructField("body", StringType()), StructField("links", ArrayType(StringType())),
])


@F.pandas_udf(PARSED)
def parsed(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(x) for x in html], columns=["title", "description", "sections", "body", "links"])


def full_text(page: Column) -> Column:
    """`section: content` of all sections, or the whole text where there is none; cleaned."""
    joined = F.array_join(F.transform(page["sections"], lambda s: F.concat(s["section"], F.lit(": "), s["content"])), " ")
    return clean(F.when(F.size(page["sections"]) > 0, joined).otherwise(page["body"]))


def build_documents(df: DataFrame, key: str, url: str, html: str, method: str = "requests") -> DataFrame:
    """(key, url, title, description, content, content_length, word_count, chunk_count, status, method, suitable_for_rag)."""
    page = df.select(key, url, parsed(html).alias("page"))
    title = F.coalesce(F.nullif("page.title", F.lit("")), U.site_label(F.col(url)), F.lit("page"))
    out = page.select(key, url, title.alias("title"), F.col("page.description").alias("description"), full_text(F.col("page")).alias("content"))
    return out.select(
        key, url, "title", "description", "content", F.length("content").alias("content_length"), T.word_count(F.col("content")).alias("word_count"),
        F.size(chunk.word_pieces(F.col("content"))).alias("chunk_count"), F.lit("success").alias("status"), F.lit(method).alias("method"), F.lit(True).alias("suitable_for_rag"),
    )


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str, least_words: int = 50) -> DataFrame:
    """Documents of the first extraction, or of the second where the first has too few words."""
    cols = [c for c in primary.columns if c != key]
    f = fallback.select(key, F.struct(*cols).alias("_f"))
    both = primary.select(key, F.struct(*cols).alias("_p")).join(f, key, "full")
    good = F.coalesce(F.col("_p.word_count") >= least_words, F.lit(False)) | F.col("_f").isNull()
    return both.select(key, F.when(good, F.col("_p")).otherwise(F.col("_f")).alias("d")).select(key, "d.*")


def links(df: DataFrame, key: str, html: str, base: str) -> DataFrame:
    """(key, link): the distinct valid links of each page, resolved against the base of the site."""
    each = df.select(key, base, F.explode(parsed(html)["links"]).alias("href"))
    u = each.select(key, U.normalize(U.resolve(F.col(base), F.trim("href"))).alias("link"), base)
    return u.filter(U.is_valid(F.col("link")) & U.is_internal(F.col("link"), F.col(base))).select(key, "link").distinct()
