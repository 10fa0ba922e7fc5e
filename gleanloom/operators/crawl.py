"""Captured pages and their link graph."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanloom.functions import urls
from gleanloom.functions.html import without_comments, without_elements
from gleanloom.operators.cleaning import audit_pages, extract_content
from gleanloom.scale import broadcast_if_small, cut_lineage, explode_once, fits_broadcast, top_ranked, written

# Fixed value: most pages visited per source, a limit that callers name.
MAX_PAGES = 100


def scan_pages(pages: DataFrame) -> DataFrame:
    """Each URL once: the first capture by page_id, unknown ids last, then by the html's hash.

    URLs are counted first; ids and hashes are compared of repeated ones only. The html moves only when the repeated URLs are too
    many to broadcast, and that of a repeated URL's first captures.
    """
    order = F.struct(F.col("page_id").isNull(), "page_id", F.coalesce(F.md5("html"), F.lit("")))
    named = pages.where(F.col("url").isNotNull())
    repeated = cut_lineage(named.groupBy("url").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    if repeated.isEmpty():
        return named
    first = named.join(broadcast_if_small(repeated), "url", "left_semi").groupBy("url").agg(F.min(order).alias("_first"))
    placed = named.join(broadcast_if_small(cut_lineage(first)), "url", "left")
    once = placed.where(F.col("_first").isNull())
    again = placed.where(F.col("_first") == order).dropDuplicates(["url"])
    return once.unionByName(again).select(*pages.columns)


def hrefs(html: Column) -> Column:
    """The link targets of a page as written, in their order; those in comments, scripts and styles are none."""
    visible = without_elements(without_comments(F.coalesce(html, F.lit(""))), ["script", "style"])
    return F.regexp_extract_all(visible, F.lit(r"""(?i)<a\s(?:[^<>]*\s)?href\s*=\s*["']([^"'<>]+)["']"""), 1)


def extract_links(pages: DataFrame) -> DataFrame:
    """Every resolvable link of every page: ``(page_id, src, href, dst)``; links in comments, scripts and styles are none.

    ``pages(page_id, url, html)``, or ``pages(page_id, url, hrefs)`` where these have been read. What a link needs of its page's URL is
    computed once per page.
    """
    read = pages.select("page_id", F.col("url").alias("src"), "hrefs" if "hrefs" in pages.columns else hrefs(F.col("html")).alias("hrefs"))
    named = read.select("*", urls.base_parts(F.col("src")).alias("_base"))
    # resolved inside the array: as a column, a filter on it would run the whole expression twice
    plain = F.transform("hrefs", lambda h: F.replace(h, F.lit("&amp;"), F.lit("&")))
    resolved = F.transform(plain, lambda link: urls.resolve_by_parts(F.col("_base"), link))
    found = explode_once(named, F.arrays_zip(F.col("hrefs").alias("href"), resolved.alias("dst")), "at", "_link", ["page_id", "src"])
    return found.select("page_id", "src", "_link.href", "_link.dst").where("dst IS NOT NULL")


def filter_links(links: DataFrame, root_path: str | None = None, same_domain: bool = False) -> DataFrame:
    """Links that a crawl would follow; ``root_path`` is a column of ``links`` unless given.

    ``same_domain`` also asks that a link stays on the registrable domain of its page.
    """
    prefix = F.col("root_path") if root_path is None else F.lit(root_path)
    followed = links.where(urls.is_followed(F.col("dst"), prefix))
    if not same_domain:
        return followed
    domains = [urls.registrable_domain(urls.host(F.col(c))) for c in ("src", "dst")]
    return followed.where(domains[0] == domains[1])


def _with_domain(df: DataFrame, url: str, suffixes: DataFrame | None) -> DataFrame:
    df = df.withColumn("_host", urls.host(F.col(url)))
    if suffixes is None:
        return df.withColumn("domain", urls.registrable_domain(F.col("_host"))).drop("_host")
    # longest listed suffix plus one label; hosts without a listed suffix use the default rule
    labels = F.split("host", r"\.")
    tail = F.array_join(F.slice(labels, F.col("at") + 1, F.size(labels)), ".")
    hosts = df.select(F.col("_host").alias("host")).where("host is not null").distinct()
    listed = (
        hosts.select("host", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("at"))
        .select("host", "at", tail.alias("suffix"))
        .join(broadcast_if_small(suffixes.select("suffix").distinct()), "suffix", "left_semi")
        .groupBy("host")
        .agg(F.min("at").alias("at"))
    )
    named = hosts.join(listed, "host", "left").select(
        F.col("host").alias("_host"),
        F.coalesce(
            F.when(F.col("at") > 0, F.array_join(F.slice(labels, F.greatest("at", F.lit(1)), F.size(labels)), ".")),
            urls.registrable_domain(F.col("host")),
        ).alias("domain"),
    )
    return df.join(named, "_host", "left").drop("_host")


def scope_pages(pages: DataFrame, sources: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Pages of each source: same registrable domain, path under the root's path (plain prefix).

    A hash join on (domain, prefix): a page's path is cut at the lengths that the root paths of its domain have, so that it
    meets the roots that hold it and no others, however many there are. When the roots are too many to broadcast, only
    distinct (domain, path) pairs are cut and joined, and the pages fetch their sources by that pair.
    """
    roots = _with_domain(sources, "url", suffixes).select(
        *[c for c in sources.columns if c != "url"], "domain", urls.path(F.col("url")).alias("root_path")
    ).where("domain IS NOT NULL AND root_path IS NOT NULL")
    placed = _with_domain(pages, "url", suffixes).withColumn("path", urls.path(F.col("url")))
    lengths = roots.groupBy("domain").agg(F.collect_set(F.length("root_path")).alias("_lengths"))

    def matched(rows: DataFrame, held: DataFrame) -> DataFrame:
        fitting = F.filter("_lengths", lambda n: n <= F.length("path"))
        cut = rows.join(broadcast_if_small(lengths, bound=roots), "domain").withColumn("_length", F.explode(fitting))
        return cut.withColumn("root_path", F.substr("path", F.lit(1), F.col("_length"))).drop("_lengths", "_length").join(held, ["domain", "root_path"])

    columns = [*pages.columns, *[c for c in sources.columns if c != "url"], "root_path"]
    if fits_broadcast(roots):
        return matched(placed, F.broadcast(roots)).select(*columns)
    pairs = matched(placed.select("domain", "path").distinct(), roots)
    return placed.join(pairs, ["domain", "path"]).select(*columns)


def reachable_pages(
    roots: DataFrame, links: DataFrame, limit: int | None, captured: DataFrame | None = None, expanded: DataFrame | None = None
) -> DataFrame:
    """Breadth-first walk per source: ``(source_id, url, depth)``, at most ``limit`` pages each, all of them for None.

    ``roots(source_id, url)``; ``links(src, dst)`` holds admitted links. When admission depends on the source, links have a
    column ``source_id``, or a column ``scope`` that the roots have too. ``captured(url)`` limits the walk to pages that
    were fetched; of pages outside ``expanded(url)`` no links are followed, though they are visited.

    Pages are taken by (depth, url); a source that has reached the limit leaves the frontier, as do pages without links. URLs are
    numbered in their order, so that the walk handles numbers. Of each page only the ``limit`` smallest targets are kept: a target
    among the pages that are taken next has fewer than ``limit`` smaller ones on its page, seen or not. A level first meets the smallest
    targets of each page; where these suffice for a source, its others count only below the largest one that is taken so far.
    Each level is written; the loop ends with the frontier.
    """
    key = next((c for c in ("source_id", "scope") if c in links.columns), None)
    edges = links.select(*([F.col(key).alias("key")] if key else []), "src", "dst").where(F.col("src") != F.col("dst"))
    if captured is not None:
        known = captured.select("url").distinct()
        roots = roots.join(known, "url", "left_semi")
        edges = edges.join(known.withColumnRenamed("url", "dst"), "dst", "left_semi")
    if expanded is not None:
        edges = edges.join(expanded.select(F.col("url").alias("src")).distinct(), "src", "left_semi")
    edges = written(edges.distinct(), "links")
    starts = written(roots.select(F.col("source_id").alias("s"), *([F.col(key).alias("key")] if key else []), "url").where("s IS NOT NULL").distinct(), "roots")
    named = [edges.select(F.col("src").alias("url"), F.lit(True).alias("leads")), edges.select("dst", F.lit(False)), starts.select("url", F.lit(False))]
    numbers = _numbered(functools.reduce(DataFrame.union, named).groupBy("url").agg(F.max("leads").alias("leads")), "url", "n")
    small = broadcast_if_small(numbers)
    edges = edges.join(small.select(F.col("url").alias("src"), F.col("n").alias("from")), "src").drop("src")
    edges = edges.join(small.withColumnRenamed("url", "dst"), "dst").drop("dst")
    starts = starts.join(small, "url").drop("url")
    if key:
        groups = broadcast_if_small(_numbered(starts.select("key").distinct(), "key", "g"))
        edges, starts = edges.join(groups, "key").drop("key"), starts.join(groups, "key").drop("key")
    near = ["g", "from"] if key else ["from"]
    if limit is not None:
        edges = top_ranked(edges, near, [F.col("n")], limit)
    edges = written(edges, "edges")
    most = 0 if limit is None else edges.agg(F.coalesce(F.max("rank"), F.lit(0))).first()[0] + 1
    own = near[:-1]
    of_source = Window.partitionBy("s")

    def counted(level: DataFrame, before: Column) -> DataFrame:
        """``taken``: pages that the source has by now; ``width``: those of this level that have links."""
        if limit is None:
            return written(level, "level")
        return written(level.withColumns({"taken": before + F.count(F.lit(1)).over(of_source), "width": F.sum(F.col("leads").cast("long")).over(of_source)}), "level")

    def unseen(met: DataFrame, seen: DataFrame) -> DataFrame:
        """The targets met that their sources have not seen, of a limited walk the smallest that still fit, with their ``place``."""
        facts = [c for c in met.columns if c not in ("s", "n")]
        # one aggregate removes repeated targets and those that were seen, whose facts are all null
        old = seen.select("s", "n", *[F.lit(None).cast(met.schema[c].dataType).alias(c) for c in facts])
        rows = met.unionByName(old)
        if limit is not None:
            # a limited walk meets few targets of a source: dealt by source once, for the aggregate and for both windows
            rows = rows.repartition("s")
        fresh = rows.groupBy("s", "n").agg(*[F.max(c).alias(c) for c in facts], F.max(F.col("leads").isNull()).alias("_seen"))
        fresh = fresh.where("NOT _seen").drop("_seen")
        if limit is None:
            return fresh
        # the constant bound lets each task drop the rest before the shuffle
        fresh = fresh.withColumn("place", F.row_number().over(of_source.orderBy("n")))
        return fresh.where((F.col("place") <= limit) & (F.col("place") <= F.lit(limit) - F.col("taken")))

    frontier, levels, depth = counted(starts.distinct(), F.lit(0)), [], 0
    while True:
        levels.append(frontier.select("s", "n", F.lit(depth).alias("depth")))
        seen = functools.reduce(DataFrame.unionByName, levels)
        growing = frontier.where("leads" if limit is None else (F.col("leads") & (F.col("taken") < limit))).drop("leads").withColumnRenamed("n", "from")
        if growing.isEmpty():
            return seen.join(numbers.drop("leads"), "n").select(F.col("s").alias("source_id"), "url", "depth")
        sources = growing.select("s").distinct()
        held = seen.join(F.broadcast(sources), "s", "left_semi") if fits_broadcast(sources) else seen
        if limit is None:
            fresh = unseen(edges.join(broadcast_if_small(growing), near).select("s", *own, "n", "leads"), held)
        else:
            columns = ["s", *own, "n", "leads", "taken"]
            first = F.col("rank") * F.col("width") < 2 * (limit - F.col("taken"))
            met = edges.join(broadcast_if_small(growing), near)
            fresh = unseen(met.where(first).select(*columns), held)
            more = growing.where((F.col("width") * (most - 1)) >= 2 * (limit - F.col("taken")))
            if not more.isEmpty():
                fresh = written(fresh, "met")
                bounds = fresh.where(F.col("place") == limit - F.col("taken")).select("s", F.col("n").alias("bound"))
                more = more.join(broadcast_if_small(bounds), "s", "left")
                beyond = edges.join(broadcast_if_small(more), near).where(~first & (F.col("bound").isNull() | (F.col("n") < F.col("bound"))))
                fresh = unseen(beyond.select(*columns).unionByName(fresh.select(*columns)), held)
            fresh = fresh.drop("place")
        frontier, depth = counted(fresh, F.col("taken") if limit is not None else None), depth + 1


def _numbered(rows: DataFrame, name: str, number: str) -> DataFrame:
    """Rows of distinct values with numbers in the values' order."""
    ordered = rows.repartitionByRange(name).sortWithinPartitions(name)
    return written(ordered.withColumn(number, F.monotonically_increasing_id()), "numbers")


def crawl_site(pages: DataFrame, sources: DataFrame, limit: int | None = MAX_PAGES) -> DataFrame:
    """``(source_id, url, depth, drop_reason)``: the pages of ``pages(page_id, url, html)`` that a crawl from each root visits.

    Links are resolved, filtered and kept inside the root's domain and path. A page that the gate rejects is visited, with its
    ``drop_reason``, but its links are not followed. Sources of one domain and root path share their links. The html is read once.
    """
    read = scan_pages(pages).withColumn("hrefs", hrefs(F.col("html")))
    judged = written(audit_pages(extract_content(read)).select("page_id", "url", "drop_reason", "hrefs"), "judged")
    scope = F.concat_ws("\n", urls.registrable_domain(urls.host(F.col("url"))), urls.path(F.col("url")))
    captured = judged.select("url")
    roots = sources.select("source_id", "url").withColumn("scope", scope).join(captured, "url", "left_semi")
    scopes = roots.groupBy("scope").agg(F.min("url").alias("url"))
    # whether a link is followed, and in which scopes, is asked once of each captured page that it can lead to
    targets = scope_pages(captured.where(urls.is_followed(F.col("url"), F.lit(""))), scopes).select("scope", F.col("url").alias("dst"))
    links = extract_links(judged.where("drop_reason IS NULL")).select("src", "dst").join(targets, "dst").select("scope", "src", "dst")
    walked = reachable_pages(roots, links, limit)
    judged = judged.select("url", "drop_reason")
    return walked.join(judged, "url").select("source_id", "url", "depth", "drop_reason")


def cut_sources(walked: DataFrame, links: DataFrame, limit: int) -> DataFrame:
    """``(source_id, n_pages, cut)``: whether the walk of a source ended at its limit with links left to follow.

    One link tells: of a source at its limit, the largest target is looked up first, then the largest of each of its pages, and all
    its links only where those were visited.
    """
    keys = ["source_id"] if "source_id" in links.columns else []
    sizes = written(walked.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_pages")), "sizes")
    pages = walked.select("source_id", F.col("url").alias("src"))
    each = links.select(*keys, "src", F.col("dst").alias("url"))
    # read twice: the links themselves are grouped once, and met again only for sources that are still undecided
    last = written(each.groupBy(*keys, "src").agg(F.max("url").alias("url")), "last")
    undecided, found = sizes.where(F.col("n_pages") >= limit).select("source_id"), []
    for targets in (last, last, each):
        ends = pages.join(broadcast_if_small(undecided), "source_id", "left_semi").join(targets, [*keys, "src"])
        ends = ends.select("source_id", "url").distinct() if found else ends.groupBy("source_id").agg(F.max("url").alias("url"))
        unseen = ends.join(walked.select("source_id", "url"), ["source_id", "url"], "left_anti")
        found.append(written(unseen.select("source_id").distinct(), "cut"))
        undecided = written(undecided.join(broadcast_if_small(found[-1]), "source_id", "left_anti"), "undecided")
        if undecided.isEmpty():
            break
    cut = functools.reduce(DataFrame.union, found).withColumn("cut", F.lit(True))
    return sizes.join(broadcast_if_small(cut), "source_id", "left").select("source_id", "n_pages", F.coalesce("cut", F.lit(False)).alias("cut"))
