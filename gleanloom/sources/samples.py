"""Model tables derived by Spark from the driver's test tables (mapping: FIXTURES.md)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanloom.functions import text, urls
from gleanloom.sources.tables import read_table


def _id(name: str) -> Column:
    return F.col(name).cast("string")


def _utc(name: str) -> Column:
    return F.col(name).cast("timestamp")


def workspaces(spark: SparkSession, folder: str) -> DataFrame:
    first_order = read_table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first_order")
    )
    return (
        read_table(spark, folder, "customer")
        .join(first_order, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            _id("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("description"),
            _id("c_nationkey").alias("user_id"),
            _utc("first_order").alias("created_at"),
        )
    )


def sources(spark: SparkSession, folder: str) -> DataFrame:
    slug = F.regexp_replace("o_orderpriority", "[^A-Za-z0-9]+", "-")
    status = F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "P", "FAILED")
    return read_table(spark, folder, "orders").select(
        _id("o_orderkey").alias("id"),
        F.concat(F.lit("https://site.example.com/"), slug).alias("url"),
        _id("o_custkey").alias("workspace_id"),
        status.otherwise("DONE").alias("status"),
        F.lit(7).alias("page_count"),
        F.lit(70).alias("chunk_count"),
        F.when(F.col("o_orderstatus") == "P", "timeout").alias("error"),
        _utc("o_orderdate").alias("created_at"),
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """One message per order line: the large table of the reports."""
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return (
        read_table(spark, folder, "lineitem")
        .select("l_orderkey", "l_linenumber")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), _id("o_custkey").alias("workspace_id")
        )
    )


def chat_messages(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        _id("conv_id").alias("workspace_id"),
        F.upper("role").alias("role"),
        F.col("text").alias("content"),
    )


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "pages", spread=True).select("page_id", "url", "html")


def earlier_pages(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as an earlier crawl found them: one in eight had a notice at its end, one in sixteen lay at another URL."""
    group = F.substring(F.md5("url"), 1, 1)
    notice = F.replace("html", F.lit("</article>"), F.lit("<p>An earlier notice, since taken down by its author.</p></article>"))
    return pages(spark, folder).select(
        "page_id",
        F.when(group == "2", F.concat("url", F.lit("/before"))).otherwise(F.col("url")).alias("url"),
        F.when(group.isin("0", "1"), notice).otherwise(F.col("html")).alias("html"),
    )


def page_sources(spark: SparkSession, folder: str) -> DataFrame:
    """One source per registrable domain of the captured pages, rooted at the site; its workspace is the TLD."""
    domain = urls.registrable_domain(urls.host(F.col("url")))
    return (
        read_table(spark, folder, "pages")
        .select(domain.alias("domain"))
        .distinct()
        .select(
            F.concat(F.lit("src-"), F.col("domain")).alias("source_id"),
            F.regexp_extract("domain", r"([^.]+)$", 1).alias("workspace_id"),
            F.concat(F.lit("https://"), F.col("domain"), F.lit("/")).alias("url"),
        )
    )


def language_sources(spark: SparkSession, folder: str) -> DataFrame:
    """One source per domain and first path segment: the path prefix matters here."""
    url = F.col("url")
    domain = urls.registrable_domain(urls.host(url))
    segment = F.regexp_extract(urls.path(url), r"^/([^/]*)", 1)
    return (
        read_table(spark, folder, "pages")
        .select(domain.alias("domain"), segment.alias("segment"))
        .distinct()
        .select(
            F.concat_ws("/", "domain", "segment").alias("source_id"),
            F.concat(F.lit("https://"), F.col("domain"), F.lit("/"), F.col("segment")).alias("url"),
        )
    )


def page_text(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as cleaned pages, each opening with a heading line."""
    return read_table(spark, folder, "documents", spread=True).select(
        F.col("source").alias("source_id"),
        F.col("lang").alias("workspace_id"),
        F.concat(F.lit("doc://"), F.col("doc_id")).alias("page_url"),
        F.col("source").alias("page_title"),
        F.concat(F.lit("# "), F.col("source"), F.lit("\n"), F.col("text")).alias("content"),
    )


def search_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document is one searchable chunk."""
    return read_table(spark, folder, "documents", spread=True).select(
        _id("doc_id").alias("id"),
        F.col("lang").alias("workspace_id"),
        F.col("source").alias("source_id"),
        F.concat(F.lit("doc://"), F.col("doc_id")).alias("page_url"),
        F.col("source").alias("page_title"),
        F.lit("").alias("section_heading"),
        F.col("text").alias("child_text"),
        F.md5("source").alias("parent_id"),
    )


def search_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors: those of a document in that document's workspace, the others in one of their own."""
    documents = read_table(spark, folder, "documents").select("doc_id", "lang", "source")
    return (
        read_table(spark, folder, "embeddings", spread=True)
        .join(documents, F.col("doc_id") == F.col("vec_id"), "left")
        .select(
            _id("vec_id").alias("chunk_id"),
            F.coalesce("lang", F.lit("stray")).alias("workspace_id"),
            F.coalesce("source", F.lit("stray")).alias("source_id"),
            "embedding",
        )
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of neighbouring words of every benchmark passage is a question.

    It asks in the workspace of the chunk with the passage's number and carries that chunk's vector;
    one more question asks in a workspace that does not exist.
    """
    words = text.tokens(F.col("text"))
    vectors = search_vectors(spark, folder).select("chunk_id", "workspace_id", "embedding")
    pairs = (
        read_table(spark, folder, "benchmark")
        .select(_id("item_id").alias("item_id"), words.alias("words"))
        .select("item_id", "words", F.posexplode("words").alias("position", "word"))
        .where(F.col("position") + 1 < F.size("words"))
        .select(
            "item_id",
            F.concat_ws("-", "item_id", "position").alias("question_id"),
            F.concat_ws(" ", "word", F.element_at("words", F.col("position") + 2)).alias("text"),
        )
    )
    known = pairs.join(vectors, F.col("item_id") == F.col("chunk_id")).select(
        "question_id", "workspace_id", "text", "embedding"
    )
    stray = known.where(F.col("question_id") == "0-0").select(
        F.lit("none").alias("question_id"), F.lit("xx").alias("workspace_id"), "text", "embedding"
    )
    return known.unionByName(stray)


def status_events(events: DataFrame) -> DataFrame:
    """Works on a batch or a stream of the events table."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", "PENDING")
        .when(kind == "view", "SCRAPING")
        .when(kind == "click", "CHUNKING")
        .when(kind == "purchase", "DONE")
        .otherwise("FAILED")
    )
    return events.select(
        "event_id",
        _id("user_id").alias("source_id"),
        (F.col("user_id") % 10).cast("string").alias("workspace_id"),
        status.alias("status"),
        _utc("ts").alias("ts"),
    )


def link_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Roots and links of a site made of customers, their orders and the ordered parts.

    Customer pages link to their orders, orders to their parts and parts back to their orders, so the
    graph has cycles and widens quickly; every customer page is the root of one source.
    """
    site = "https://shop.example.com"

    def page(kind: str, key: str) -> Column:
        return F.concat(F.lit(f"{site}/{kind}/"), F.col(key))

    orders = read_table(spark, folder, "orders")
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_partkey").distinct()
    order, part = page("orders", "l_orderkey"), page("parts", "l_partkey")
    links = (
        orders.select(page("customers", "o_custkey").alias("src"), page("orders", "o_orderkey").alias("dst"))
        .unionByName(lines.select(order.alias("src"), part.alias("dst")))
        .unionByName(lines.select(part.alias("src"), order.alias("dst")))
    )
    roots = read_table(spark, folder, "customer").select(
        _id("c_custkey").alias("source_id"), page("customers", "c_custkey").alias("url")
    )
    return roots, links


def shop_pages(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Html of the site of ``link_graph`` with a start page per nation, which links to its customers; a source starts at each.

    Pending orders, small parts and customers in debt have pages that say too little to pass the gate.
    """
    site = "https://shop.example.com"
    customer, orders, lines = (read_table(spark, folder, name) for name in ("customer", "orders", "lineitem"))
    # pages and their targets as (kind, number) until the html is written: a set drops repeated links, so none are dealt out for that
    kinds = (("?nation=", "customers/"), ("customers/", "orders/"), ("orders/", "parts/"), ("parts/", "orders/"))
    keys = ((customer, "c_nationkey", "c_custkey"), (orders, "o_custkey", "o_orderkey"), (lines, "l_orderkey", "l_partkey"), (lines, "l_partkey", "l_orderkey"))
    links = functools.reduce(DataFrame.unionByName, [
        df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("key"), F.col(to).cast("long").alias("to")) for kind, (df, key, to) in enumerate(keys)])
    thin = orders.where("o_orderstatus = 'P'").select(F.lit(2).alias("kind"), F.col("o_orderkey").alias("key"))
    thin = thin.unionByName(read_table(spark, folder, "part").where("p_size < 8").select(F.lit(3).alias("kind"), F.col("p_partkey").alias("key")))
    thin = thin.unionByName(customer.where("c_acctbal < 0").select(F.lit(1).alias("kind"), F.col("c_custkey").alias("key"))).withColumn("thin", F.lit(True))
    bodies = links.where("key IS NOT NULL").groupBy("kind", "key").agg(F.collect_set("to").alias("to")).join(thin, ["kind", "key"], "left")

    def named(which: int) -> Column:
        return F.element_at(F.array(*[F.lit(pair[which]) for pair in kinds]), F.col("kind") + 1)

    opening = F.concat(F.lit('<a href="/'), named(1))
    anchors = F.array_join(F.sort_array(F.transform("to", lambda to: F.concat(F.col("opening"), to, F.lit('"></a>')))), "")
    text = F.concat(F.lit("<p>Page "), "url", F.when(F.col("thin"), "").otherwise("  " + "all that there is to say " * 8), F.lit("</p>"))
    html = F.concat(F.lit("<html><head><title>Shop</title></head><body><article>"), text, F.lit("<div>"), anchors, F.lit("</div></article></body></html>"))
    made = bodies.select(F.concat(F.lit(f"{site}/"), named(0), "key").alias("url"), opening.alias("opening"), "to", "thin")
    made = made.select(F.xxhash64("url").alias("page_id"), "url", html.alias("html"))
    start = F.concat(F.lit(f"{site}/?nation="), "c_nationkey")
    roots = customer.select(F.col("c_nationkey").cast("string").alias("source_id"), start.alias("url")).distinct()
    return made, roots
