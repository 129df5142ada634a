"""Main text of pages, without what their sites repeat.

Every page gives the hashes of its element subtrees; Spark counts, for each host, the different pages that have each. A
subtree on many pages of its host is template and is deleted from them. What is left of the article is the text: the
article element, where a page has one, or else all that is neither template nor named as furniture by its tag, class, id
or role.

An article may well quote what other articles quote. So inside an article element, repeated paragraphs, headings, lists
and tables of text stay; repeated divisions and blocks that are mostly links go.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumforge.llm._shared import fresh, table, written
from sumforge.llm.markup import HEADINGS, Page

#: A template is on so many different pages of its host at least, and on so large a part of them.
LEAST, SHARE = 3, 0.1
#: A host with more than this part of all pages is dealt out to several tasks.
HEAVY = 1 / 1024
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: Blocks of text that an article may share with others.
FLOW = HEADINGS | frozenset("p blockquote pre ul ol li dl dt dd table caption thead tbody tfoot tr td th figcaption".split())


def subtrees(source: str) -> tuple[int, set[int]]:
    """Hash of a page, and of the element subtrees in it that have text; the page's own among them."""
    page = Page(source)
    return page.digests[0], {d for d in page.digests if d}


def main_text(source: str, templates: frozenset[int] = frozenset()) -> str:
    """The blocks of a page's main text, one a line, without subtrees whose hash is in templates."""
    page = Page(source)
    names, parents, n = page.names, page.parents, len(page.names)
    # a name like a furniture's does not count for what the article is in, nor for the only articles there are
    holds_main, named = [False] * n, all(f for f, m in zip(page.flags, page.mains, strict=True) if m)
    for k in range(n - 1, 0, -1):
        holds_main[parents[k]] |= holds_main[k] or page.mains[k]
        holds_main[k] |= named and page.mains[k]
    # kept: 0 text, 1 gone, 2 a header inside an article, of which the headings stay
    kept, in_main = [0] * n, [False] * n
    for k in range(1, n):
        up, flag = parents[k], page.flags[k]
        in_main[k] = page.mains[k] or in_main[up]
        if kept[up] == 1 or flag == "silent":
            kept[k] = 1
        elif flag and not (holds_main[k] and (flag != "tag" or names[k] == "form")):
            kept[k] = 1 if flag != "header" or not in_main[k] else 0 if names[k] in HEADINGS else 2
        elif kept[up] == 2:
            kept[k] = 0 if names[k] in HEADINGS else 2
    sizes, linked = [0] * n, [0] * n
    for k, value, link in page.texts:
        if value and not kept[k]:
            here = len(value) - value.count(" ")
            sizes[k] += here
            linked[k] += here * link
    for k in range(n - 1, 0, -1):
        sizes[parents[k]] += sizes[k]
        linked[parents[k]] += linked[k]
    region = _region(page, kept, sizes)
    inside = [False] * n
    for k in range(n):
        inside[k] = k in region or k > 0 and inside[parents[k]]
    explicit = any(page.mains[k] for k in region)
    for k in range(1, n):
        if kept[parents[k]] == 1:
            kept[k] = 1
        elif k not in region and inside[k] and names[k] != "body":
            links = 2 * linked[k] > sizes[k]
            if page.digests[k] in templates and (not explicit or links or names[k] not in FLOW):
                kept[k] = 1
            elif not explicit and links and names[k] in ("ul", "ol", "dl", "table", "div", "p", "center"):
                kept[k] = 1
    blocks, now = [], []
    for k, value, _ in page.texts:
        if value is None:
            if now:
                blocks.append("".join(now))
                now = []
        elif inside[k] and not kept[k]:
            now.append(value)
    blocks.append("".join(now))
    return "\n".join(filter(None, (" ".join(b.split()) for b in blocks)))


def _region(page: Page, kept: list[int], sizes: list[int]) -> set[int]:
    """The outermost articles that are at least half as long as the longest; without any, the main elements, or the page."""
    for wanted in (lambda k: page.names[k] == "article", lambda k: page.mains[k]):
        found, below = [], [False] * len(kept)
        for k in range(1, len(kept)):
            below[k] = below[page.parents[k]]
            if not below[k] and not kept[k] and page.mains[k] and wanted(k):
                below[k] = True
                found.append(k)
        if found and (longest := max(sizes[k] for k in found)):
            return {k for k in found if 2 * sizes[k] >= longest}
    return {0}


def site_templates(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", least: int = LEAST, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """(host, part, templates): the template hashes of each host, for each part that its pages are dealt into; and (host, parts) of the heavy hosts.

    Host is a hash of the host's name. Pages with the same content count once, so copies of a page are no templates. A
    host has at most 1 / share templates for each subtree of an average page; there are fewer heavy hosts than 1 / HEAVY.
    """
    source = pages.select(_host(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).where("host IS NOT NULL")

    def hashes(batches):
        for batch in batches:
            hosts, found, whole = [], [], []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own, each = subtrees(source.as_py())
                hosts += [host] * len(each)
                found += each
                whole += [own] * len(each)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (hosts, found, whole)], ["host", "subtree", "page"])

    found = source.mapInArrow(hashes, "host long, subtree long, page long").distinct()
    counts = written(found.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("pages"), F.max((F.col("subtree") == F.col("page")).cast("int")).alias("whole")).where(f"pages >= {least} OR whole = 1"), "subtrees")
    hosts = written(counts.where("whole = 1").groupBy("host").agg(F.count(F.lit(1)).alias("all")), "hosts")
    total = hosts.agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0]
    heavy = hosts.where(F.col("all") > HEAVY * total).select("host", F.ceil(F.col("all") / (HEAVY * total)).cast("int").alias("parts")) if total else hosts.select("host", F.lit(1).alias("parts"))
    frequent = counts.where(F.col("pages") >= least).join(hosts, "host").where(F.col("pages") >= share * F.col("all"))
    templates = frequent.groupBy("host").agg(F.collect_list("subtree").alias("templates")).join(F.broadcast(heavy), "host", "left")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    return written(templates.select("host", parts, "templates"), "templates"), heavy


def _host(url_col: str):
    name = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), HOST, 1))
    return F.when(name != "", F.xxhash64(name))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(id_col, url_col, text, n_chars) for each row of pages.

    A null page is an empty one, whose text is empty; pages without a host have no templates; repeated rows and null ids
    give a row each; other columns are not read. Templates are joined to the pages by host and part: where their
    table is small Spark sends it to all tasks by its own size check, else both sides are dealt out.
    """
    templates, heavy = site_templates(pages, url_col=url_col, html_col=html_col, least=least, share=share)
    host, part, parts = fresh(pages.columns, "host", "part", "parts")
    rows = pages.select(id_col, url_col, F.coalesce(F.col(html_col), F.lit("")).alias(html_col), _host(url_col).alias(host))
    rows = rows.join(F.broadcast(heavy.select(F.col("host").alias(host), F.col("parts").alias(parts))), host, "left")
    rows = rows.withColumn(part, F.pmod(F.xxhash64(id_col, url_col), F.coalesce(parts, F.lit(1))).cast("int"))
    rows = rows.join(templates.select(F.col("host").alias(host), F.col("part").alias(part), "templates"), [host, part], "left")
    id_type = pages.schema[id_col].dataType.simpleString()

    def texts(batches):
        seen: tuple[object, frozenset[int]] = (None, frozenset())
        for batch in batches:
            out = []
            for host, templates, source in zip(batch.column(3).to_pylist(), batch.column(4), batch.column(2), strict=True):
                if host is None or not templates.is_valid:
                    out.append(main_text(source.as_py()))
                    continue
                if seen[0] != host:
                    seen = host, frozenset(templates.as_py())
                out.append(main_text(source.as_py(), seen[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["id", "url", "text", "n_chars"])

    found = rows.select(id_col, url_col, html_col, host, "templates").mapInArrow(texts, f"id {id_type}, url string, text string, n_chars long")
    return found.withColumnsRenamed({"id": id_col, "url": url_col})


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return extract(table(spark, sf_dir, "pages"))
