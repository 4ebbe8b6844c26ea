"""What html pages and browser sessions hold."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import markup
from gleaner.functions.text import flag


def page_links(pages: DataFrame, key: str, html: str, attribute: str = "href") -> DataFrame:
    """``key, position, link``: the values of an attribute of any element, in order. A page without any has no row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[e.attributes[attribute] for e in markup.parse(x.as_py()).elements if attribute in e.attributes] for x in batch.column(1)]
            n = [len(f) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array([k for m in n for k in range(m)], pa.int32()), pa.array([x for f in found for x in f], pa.string())], names=["key", "position", "link"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInArrow(task, f"key {kind}, position int, link string").withColumnRenamed("key", key)


# The marks of a player that is no video element, and of the element that names the user.
PLAYERS, PLAYER_LABELS, USER = ("videoPlayer", "videoComponent"), ("動画", "Video"), "User-Name"


def _post(page: markup.Page, k: int) -> dict:
    """What one article of a page has, nested ones included."""
    own = range(k + 1, page.elements[k].end)
    of = lambda *names: [i for i in own if page.elements[i].name in names]
    value = lambda i, name: page.elements[i].attributes.get(name, "")

    def around(i: int) -> str | None:
        """The link that holds an element, within the article."""
        while i >= k:
            if page.elements[i].name == "a" and value(i, "href"):
                return value(i, "href")
            i = page.elements[i].inside
        return None

    link = next((u for i in of("time") if (u := around(i))), None) or next((value(i, "href") for i in of("a") if re.search("/status/[0-9]+$", value(i, "href"))), None)
    named = next((i for i in own if value(i, "data-testid") == USER), k)
    spans = [i for i in range(named + 1, page.elements[named].end) if page.elements[i].name == "span"]
    user = next((t[1:] for i in spans if (t := markup.text_of(page, i).strip()).startswith("@") and len(t) > 1), None)
    players = any(value(i, "data-testid") in PLAYERS or page.elements[i].name == "div" and any(x in value(i, "aria-label") for x in PLAYER_LABELS) for i in own)
    return {
        "image_urls": [value(i, "src") for i in of("img") if value(i, "src")], "video_urls": [u for i in of("video", "source") if (u := value(i, "src")) and not u.startswith("blob:")],
        "has_video_element": players or bool(of("video")), "post_url": link, "username": user,
    }


def posts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """A row for each ``<article>`` of a page, nested ones too: image urls, video urls that others can open, whether it has a
    video, its link (the one around its time, else the first to a status) and its user."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of = [], []
            for n, x in enumerate(batch.column(1)):
                page = markup.parse(x.as_py())
                found = [k for k, e in enumerate(page.elements) if e.name == "article"]
                rows += [{"position": i} | _post(page, k) for i, k in enumerate(found)]
                of += [n] * len(found)
            made = pa.RecordBatch.from_pylist(rows, fields)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *made.columns], names=["key", *fields.names])

    fields = pa.schema([("position", pa.int32()), ("image_urls", pa.list_(pa.string())), ("video_urls", pa.list_(pa.string())), ("has_video_element", pa.bool_()), ("post_url", pa.string()), ("username", pa.string())])
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInArrow(task, f"key {kind}, position int, image_urls array<string>, video_urls array<string>, has_video_element boolean, post_url string, username string").withColumnRenamed("key", key)


def outlines(pages: DataFrame, key: str, html: str, decoded: Callable[[str], str] = unescape) -> DataFrame:
    """``key, title, heading, n_links, n_paragraphs, n_articles`` of each page: the first title's and main heading's text, or null.
    Character references in them are ``decoded``."""

    def one(source: str | None) -> dict:
        page = markup.parse(source, decoded)
        names = [e.name for e in page.elements]
        first = lambda name: markup.text_of(page, names.index(name)) if name in names else None
        return {"title": first("title"), "heading": first("h1"), "n_links": sum("href" in e.attributes for e in page.elements), "n_paragraphs": names.count("p"), "n_articles": names.count("article")}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.RecordBatch.from_pylist([one(x.as_py()) for x in batch.column(1)], fields)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns], names=["key", *fields.names])

    fields = pa.schema([("title", pa.string()), ("heading", pa.string()), *((n, pa.int32()) for n in ("n_links", "n_paragraphs", "n_articles"))])
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInArrow(task, f"key {kind}, title string, heading string, n_links int, n_paragraphs int, n_articles int").withColumnRenamed("key", key)


def video_posts(rows: DataFrame) -> DataFrame:
    """Posts with a video, by element or by url; the post's link or else its first video url is the key."""
    has = F.col("has_video_element") | (F.size("video_urls") > 0)
    return rows.where(has).withColumn("video_key", F.coalesce("post_url", F.get("video_urls", F.lit(0)))).where("video_key is not null")


COOKIES = "cookies array<struct<name:string,value:string,domain:string,path:string,expires:double,secure:boolean>>"


def cookie_lines(spark: SparkSession, session: DataFrame, value: str = "value") -> DataFrame:
    """The cookies of a session's JSON as lines of seven fields between tabs; missing members get their defaults."""
    cookie = session.select(F.explode(F.from_json(value, COOKIES)["cookies"]).alias("c")).select("c.*")
    domain = F.coalesce("domain", F.lit(""))
    fields = [domain, flag(F.startswith(domain, F.lit("."))), F.coalesce("path", F.lit("/")), flag(F.col("secure")), F.coalesce(F.col("expires"), F.lit(0.0)).cast("long").cast("string"), F.coalesce("name", F.lit("")), F.coalesce("value", F.lit(""))]
    return cookie.select(F.concat_ws("\t", *fields).alias("value"))
