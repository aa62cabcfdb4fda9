"""Store pages: the fields of an app page and the links of a list page."""

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from reviewloom.functions import fields

# Blocks of an app page, and widths of the labels before the
# developer, size and seller texts.
TITLE_BLOCK, LEFT_BLOCK = "title", "left-stack"
RATING_CLASSES = ("customer-ratings", "rating")
DEVELOPER_PREFIX, SIZE_PREFIX, SELLER_PREFIX = 3, 6, 8
SIZE_ITEM, SELLER_ITEM = 4, 6
VOID = {"meta", "link", "img", "br", "hr", "input", "source", "area", "base", "col", "embed",
        "track", "wbr"}

_NODES = StructType([
    StructField("title", StringType()),
    StructField("developer", StringType()),
    StructField("items", ArrayType(StringType())),
    StructField("category", StringType()),
    StructField("label", StringType()),
])


class _AppPage(HTMLParser):
    """Collects the texts of the wanted nodes of one page."""

    def __init__(self) -> None:
        super().__init__()
        self.path: list[tuple[str, dict]] = []
        self.title = self.developer = self.category = self.label = None
        self.items: list[str] = []

    def _inside(self, block: str) -> bool:
        return any(a.get("id") == block for _, a in self.path)

    def _class(self, name: str) -> bool:
        return any(name in (a.get("class") or "").split() for _, a in self.path)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        self.path.append((tag, dict(attrs)))
        if tag == "li" and self._inside(LEFT_BLOCK):
            self.items.append("")
        if self.label is None and all(self._class(c) for c in RATING_CLASSES):
            self.label = self.path[-1][1].get("aria-label")

    def handle_endtag(self, tag: str) -> None:
        while self.path and any(t == tag for t, _ in self.path):
            if self.path.pop()[0] == tag:
                break

    def handle_data(self, data: str) -> None:
        tags = [t for t, _ in self.path]
        if self._inside(TITLE_BLOCK) and "h1" in tags:
            self.title = (self.title or "") + data
        if self._inside(TITLE_BLOCK) and "h2" in tags:
            self.developer = (self.developer or "") + data
        if self.items and self._inside(LEFT_BLOCK) and "li" in tags:
            self.items[-1] += data
            if self._class("genre") and "a" in tags:
                self.category = (self.category or "") + data


@F.pandas_udf(_NODES)
def _page_nodes(html: pd.Series) -> pd.DataFrame:
    rows = []
    for text in html:
        page = _AppPage()
        try:
            page.feed(text or "")
        except (AssertionError, ValueError):
            # The parser gives up on some broken declarations: the page has no fields.
            page = _AppPage()
        rows.append((page.title, page.developer, page.items, page.category, page.label))
    return pd.DataFrame(rows, columns=["title", "developer", "items", "category", "label"])


def app_pages(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Fields of app pages with their url; `complete` tells failed pages apart."""
    rows = pages.select(F.col(url).alias("url"), _page_nodes(html).alias("p"))
    p = F.col("p")
    rating = fields.rating_parts(p["label"])
    out = rows.select(
        p["title"].alias("title"),
        fields.after_prefix(p["developer"], DEVELOPER_PREFIX).alias("developer"),
        F.get(p["items"], F.lit(0)).alias("price"), p["category"].alias("category"),
        fields.after_prefix(F.get(p["items"], F.lit(SIZE_ITEM)), SIZE_PREFIX).alias("size"),
        fields.after_prefix(F.get(p["items"], F.lit(SELLER_ITEM)), SELLER_PREFIX).alias("seller"),
        rating["stars"].alias("stars"), rating["ratings"].alias("rating"), "url")
    whole = F.lit(True)
    for c in out.columns:
        whole = whole & F.col(c).isNotNull()
    return out.withColumn("complete", whole)


def page_link_rows(pages: DataFrame, page_id: str, html: str = "html") -> DataFrame:
    """One row per link of a page, (page, href)."""
    return pages.select(page_id, F.explode(fields.page_links(html)).alias("href"))
