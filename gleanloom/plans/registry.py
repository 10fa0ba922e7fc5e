"""Every operator run over whole tables of a test folder: the callables behind ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanloom.functions import ids, text, urls
from gleanloom.functions.splitter import CHILD_LEVEL
from gleanloom.operators import chunking, cleaning, crawl, embedding, fusion, keyword, reports, tables, vector
from gleanloom.plans import ingest, refresh, retrieval
from gleanloom.scale import cut_lineage, scratch_path
from gleanloom.sources import samples, stored
from gleanloom.sources.model import PAGES, SOURCE_STATUS
from gleanloom.sources.tables import read_by_workspace, read_table, write_by_workspace
from gleanloom.streaming import ingest as stream_tables
from gleanloom.streaming import stages
from gleanloom.streaming import status as stream_status
from gleanloom.streaming.sinks import latest_by, read_epochs, write_epochs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- crawl -----------------------------------------------------------------------------------------


@_query
def scan_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Captures by site root, so that most repeat."""
    pages = samples.pages(spark, folder).withColumn("url", F.regexp_extract("url", r"^[a-z]+://[^/]+", 0))
    return crawl.scan_pages(pages).select("page_id", "url", F.md5("html").alias("html_md5"))


@_query
def extract_links(spark: SparkSession, folder: str) -> DataFrame:
    return crawl.extract_links(samples.pages(spark, folder))


def _links_with_self(spark: SparkSession, folder: str) -> DataFrame:
    pages = samples.pages(spark, folder)
    links = crawl.extract_links(pages).select("page_id", "src", "dst")
    return links.unionByName(pages.select("page_id", F.col("url").alias("src"), F.col("url").alias("dst")))


@_query
def filter_links(spark: SparkSession, folder: str) -> DataFrame:
    links = _links_with_self(spark, folder)
    return crawl.filter_links(links.withColumn("root_path", F.substr(urls.path(F.col("src")), F.lit(1), F.lit(2))))


@_query
def scope_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = samples.pages(spark, folder).select("page_id", "url")
    return crawl.scope_pages(pages, samples.language_sources(spark, folder))


@_query
def reachable_pages(spark: SparkSession, folder: str) -> DataFrame:
    return crawl.reachable_pages(*samples.link_graph(spark, folder), limit=crawl.MAX_PAGES)


@_query
def reachable_all(spark: SparkSession, folder: str) -> DataFrame:
    """Without a limit, over links that only lead down: every source ends by itself."""
    roots, links = samples.link_graph(spark, folder)
    down = links.where(~F.col("src").contains("/parts/"))
    return crawl.reachable_pages(roots, down, limit=None)


@_query
def cut_sources(spark: SparkSession, folder: str) -> DataFrame:
    roots, links = samples.link_graph(spark, folder)
    walked = cut_lineage(crawl.reachable_pages(roots, links, limit=crawl.MAX_PAGES))
    return crawl.cut_sources(walked, links, crawl.MAX_PAGES)


@_query
def crawl_site(spark: SparkSession, folder: str) -> DataFrame:
    """From html to the walk, with pages that the gate rejects: visited, but not followed."""
    return crawl.crawl_site(*samples.shop_pages(spark, folder), limit=10 * crawl.MAX_PAGES)


# --- intake and table maintenance ------------------------------------------------------------------


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    """Unfinished sources asked for again: urgent ones by a stranger, low ones by a broken URL."""
    owner = samples.workspaces(spark, folder).select(F.col("id").alias("workspace_id"), "user_id")
    asked = samples.sources(spark, folder).where(F.col("status") != "DONE").join(owner, "workspace_id")
    stranger = (F.col("user_id").cast("int") + 1).cast("string")
    return asked.select(
        "id",
        F.when(F.col("url").endswith("/5-LOW"), "site.example.com/5-LOW").otherwise(F.col("url")).alias("url"),
        "workspace_id",
        F.when(F.col("url").endswith("/1-URGENT"), stranger).otherwise(F.col("user_id")).alias("user_id"),
        "created_at",
    )


@_query
def intake_sources(spark: SparkSession, folder: str) -> DataFrame:
    existing = samples.sources(spark, folder).where(F.col("status") == "DONE")
    parts = tables.intake_sources(_requests(spark, folder), samples.workspaces(spark, folder), existing)
    named = zip(("accepted", "conflict", "rejected"), parts, strict=True)
    frames = [part.select("id", "url", "workspace_id", F.lit(name).alias("outcome")) for name, part in named]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def _chunk_updates(spark: SparkSession, folder: str) -> DataFrame:
    """Every labelled document changed, and every chat turn as a new chunk written twice."""
    labelled = (
        samples.search_chunks(spark, folder)
        .join(read_table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("id")), "id")
        .select(
            "id",
            F.lit("moved").alias("source_id"),
            F.lit("moved").alias("page_url"),
            F.concat("page_title", F.lit(" v2")).alias("page_title"),
            F.concat(F.lit("v2 "), "child_text").alias("child_text"),
            F.lit(1).alias("version"),
        )
    )
    turns = samples.chat_messages(spark, folder)

    def written(version: int, content) -> DataFrame:
        return turns.select(
            F.concat(F.lit("turn-"), "id").alias("id"),
            F.concat(F.lit("chat-"), F.lit(version)).alias("source_id"),
            F.concat(F.lit("chat://"), F.col("id"), F.lit("/"), F.lit(version)).alias("page_url"),
            F.concat(F.col("role"), F.lit(" "), F.lit(version)).alias("page_title"),
            content.alias("child_text"),
            F.lit(version).alias("version"),
        )

    return labelled.unionByName(written(1, F.col("content"))).unionByName(written(2, F.concat(F.lit("v2 "), "content")))


@_query
def merge_chunks(spark: SparkSession, folder: str) -> DataFrame:
    target = samples.search_chunks(spark, folder).select("id", "source_id", "page_url", "page_title", "child_text")
    merged = tables.merge_chunks(target, _chunk_updates(spark, folder))
    return merged.withColumn("child_text", F.md5("child_text"))


def _vector_updates(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The vectors, and updates: labelled ones replaced twice, every vector once more under another id."""
    target = samples.search_vectors(spark, folder)
    labels = read_table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("chunk_id")).distinct()
    changed = target.join(labels, "chunk_id")
    last = changed.withColumns({"embedding": F.reverse("embedding"), "version": F.lit(2)})
    first = changed.withColumns({"embedding": F.slice("embedding", 1, 8), "version": F.lit(1)})
    copy = target.select(F.concat(F.lit("copy-"), "chunk_id").alias("chunk_id"), F.lit("copies").alias("workspace_id"),
                         F.lit("copy").alias("source_id"), "embedding", F.lit(1).alias("version"))
    return target, last.unionByName(first).unionByName(copy)


@_query
def merge_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return tables.merge_vectors(*_vector_updates(spark, folder)).withColumn("embedding", _digits())


def _digits(vector: str = "embedding") -> Column:
    """MD5 of a vector's values to six decimals."""
    return F.md5(F.array_join(F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(1e6) + F.lit(0.5)).cast("string")), ","))


@_query
def store_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents stored by language, then the updates of ``merge_chunks`` in two runs; changed chunks do not move to the workspace they name."""
    path = scratch_path(spark, "stored-chunks")
    first = samples.search_chunks(spark, folder).select(
        "id", "workspace_id", "source_id", "page_url", "page_title", "section_heading", "child_text", F.substr("child_text", F.lit(1), F.lit(40)).alias("parent_text"))
    stored.store_chunks(spark, path, first.withColumn("version", F.lit(0)))
    room = F.when(F.col("id").startswith("turn-"), F.concat(F.lit("chat-"), F.substr("id", F.lit(6), F.lit(1)))).otherwise("elsewhere")
    updates = _chunk_updates(spark, folder).select(
        "id", room.alias("workspace_id"), "source_id", "page_url", "page_title", F.concat(F.lit("part "), "version").alias("section_heading"),
        "child_text", F.upper("page_title").alias("parent_text"), "version")
    for version in (1, 2):
        stored.store_chunks(spark, path, updates.where(F.col("version") == version))
    return read_by_workspace(spark, path, first.schema.simpleString()[7:-1].replace(":", " ")).withColumns(
        {"child_text": F.md5("child_text"), "parent_text": F.md5("parent_text")})


@_query
def store_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors stored by language, then the updates of ``merge_vectors``."""
    path = scratch_path(spark, "stored-vectors")
    first, updates = _vector_updates(spark, folder)
    stored.store_vectors(spark, path, first.withColumn("version", F.lit(0)))
    for version in (1, 2):
        stored.store_vectors(spark, path, updates.where(F.col("version") == version))
    vectors = read_by_workspace(spark, path, "chunk_id string, workspace_id string, source_id string, embedding array<float>")
    return vectors.withColumn("embedding", _digits())


@_query
def drop_workspaces(spark: SparkSession, folder: str) -> DataFrame:
    """The stored chunks after the languages of many toxic documents have been dropped."""
    path = scratch_path(spark, "dropped-chunks")
    chunks = samples.search_chunks(spark, folder).select("id", "workspace_id", "source_id")
    write_by_workspace(chunks, path)
    stored.drop_workspaces(spark, path, _toxic_workspaces(spark, folder))
    return read_by_workspace(spark, path, "id string, workspace_id string, source_id string")


@_query
def delete_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Sources left after their owners' requests; strangers' requests change nothing."""
    requests = _requests(spark, folder).select(F.col("id").alias("source_id"), "user_id")
    return tables.delete_sources(requests, samples.sources(spark, folder), samples.workspaces(spark, folder))


def _toxic_sources(spark: SparkSession, folder: str) -> DataFrame:
    toxic = read_table(spark, folder, "labels").where(F.col("toxic") == 1).select(
        F.col("doc_id").cast("string").alias("id")
    )
    return samples.search_chunks(spark, folder).join(toxic, "id", "left_semi").select("workspace_id", "source_id")


def _toxic_workspaces(spark: SparkSession, folder: str) -> DataFrame:
    labels = read_table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("id"), "toxic")
    chunks = samples.search_chunks(spark, folder).select("id", "workspace_id")
    toxic = chunks.join(labels, "id").groupBy("workspace_id").agg(F.avg("toxic").alias("share"))
    return toxic.where(F.col("share") > 0.125)


@_query
def delete_by_source(spark: SparkSession, folder: str) -> DataFrame:
    chunks = samples.search_chunks(spark, folder).select("id", "workspace_id", "source_id")
    return tables.delete_by_source(chunks, _toxic_sources(spark, folder))


@_query
def delete_by_workspace(spark: SparkSession, folder: str) -> DataFrame:
    chunks = samples.search_chunks(spark, folder).select("id", "workspace_id", "source_id")
    return tables.delete_by_workspace(chunks, _toxic_workspaces(spark, folder))


@_query
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Owners in debt delete their workspaces; rich strangers try to."""
    customer = read_table(spark, folder, "customer")
    rich = F.col("c_acctbal") > 9000
    requests = customer.where((F.col("c_acctbal") < 0) | rich).select(
        F.col("c_custkey").cast("string").alias("workspace_id"),
        F.when(rich, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).cast("string").alias("user_id"),
    )
    messages = samples.messages(spark, folder)
    chunks = read_table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").cast("string").alias("source_id")
    )
    parts = tables.cascade_delete_workspaces(
        requests, samples.workspaces(spark, folder), samples.sources(spark, folder), messages, chunks
    )
    kinds = ("workspace", "source", "message", "orphan_chunk")
    frames = [p.select(F.lit(kind).alias("kind"), "id") for kind, p in zip(kinds, parts, strict=True)]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


@_query
def validate_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Chat roles, workspace names, page URLs and event states against the declared limits."""
    roles = tables.validate_rows(samples.chat_messages(spark, folder), tables.role_errors(F.col("role")))
    spaces = tables.validate_rows(
        samples.workspaces(spark, folder).withColumn("name", F.repeat("name", 3)),
        tables.workspace_errors(F.col("name"), F.nullif(F.col("description"), F.lit("MACHINERY"))),
    )
    pages = samples.pages(spark, folder).select(
        F.col("page_id").cast("string").alias("id"), F.regexp_replace("url", "^http:", "").alias("url")
    )
    states = read_table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise(F.upper("event_type")).alias("status"),
    )
    checked = [
        ("message", roles),
        ("workspace", spaces),
        ("page", tables.validate_rows(pages, tables.url_errors(F.col("url")))),
        ("event", tables.validate_rows(states, tables.status_errors(F.col("status")))),
    ]
    frames = [
        df.select(F.lit(kind).alias("kind"), "id", F.array_join("errors", ",").alias("errors")) for kind, df in checked
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


@_query
def reset_for_reindex(spark: SparkSession, folder: str) -> DataFrame:
    requests = _requests(spark, folder).select(F.col("id").alias("source_id"), "user_id")
    return tables.reset_for_reindex(requests, samples.sources(spark, folder), samples.workspaces(spark, folder))


@_query
def apply_patches(spark: SparkSession, folder: str) -> DataFrame:
    """Each order line is a patch of its source; lines with flag R clear the error."""
    line = F.col("l_linenumber")
    status = F.element_at(F.array(*map(F.lit, SOURCE_STATUS)), (line % 6 + 1).cast("int"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    seq = line * 10**18 + cents * 10**9 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")
    patches = read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("id"),
        seq.alias("seq"),
        F.when(F.col("l_returnflag") != "N", status).alias("status"),
        F.when(line % 2 == 0, F.col("l_quantity").cast("int")).alias("page_count"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("line "), line)).alias("error"),
        F.when(F.col("l_returnflag") == "R", F.array(F.lit("error"))).alias("null_fields"),
    )
    rows = samples.sources(spark, folder).select("id", "status", "page_count", "chunk_count", "error")
    return tables.apply_patches(rows, patches, ["status", "page_count", "error"])


@_query
def patch_workspaces(spark: SparkSession, folder: str) -> DataFrame:
    """Each order is a patch of its customer's workspace: urgent ones come from another user, low ones carry a name that is too long."""
    priority, name, spaces = F.col("o_orderpriority"), F.concat(F.lit("order "), "o_orderkey"), samples.workspaces(spark, folder)
    asked = read_table(spark, folder, "orders").join(spaces.select(F.col("id").alias("o_id"), "user_id"), F.col("o_custkey").cast("string") == F.col("o_id"))
    patches = asked.select(
        F.col("o_id").alias("id"),
        F.when(priority == "1-URGENT", F.concat("user_id", F.lit("x"))).otherwise(F.col("user_id")).alias("user_id"),
        F.col("o_orderkey").alias("seq"),
        F.when(priority == "5-LOW", F.repeat(name, F.lit(10))).when(priority != "2-HIGH", name).alias("name"),
        F.when(F.col("o_orderstatus") == "O", priority).alias("description"),
        F.when(F.col("o_orderstatus") == "P", F.array(F.lit("description"))).alias("null_fields"),
    )
    patched, rejected = tables.patch_workspaces(patches, spaces)
    counts = rejected.groupBy("id").agg(*[F.count_if(F.array_contains("errors", e)).alias(f"n_{e}") for e in ("workspace", "name")])
    return patched.select("id", "name", "description").join(counts, "id", "left").na.fill(0, ["n_workspace", "n_name"])


@_query
def reindex_source(spark: SparkSession, folder: str) -> DataFrame:
    """All sources indexed, then all rebuilt over the stored tables: texts and vectors are those of the first run."""
    pages, sources = samples.pages(spark, folder), samples.page_sources(spark, folder)
    first = ingest.ingest(pages, sources, splitter="window")
    model = embedding.fit_embedder(first.chunks, "child_text", width=64)
    chunks = cut_lineage(first.chunks)
    vectors = ingest.embed_chunks(chunks, model)
    again, _, again_vectors = ingest.reindex(
        chunks, first.parents, vectors, pages, sources, model, splitter="window"
    )
    columns = ["id", "workspace_id", "source_id"]
    digits = again_vectors.select(F.col("chunk_id").alias("id"), "workspace_id", "source_id", _digits().alias("embedding"))
    return again.select(*columns, F.md5("child_text").alias("child_text")).join(digits, columns, "full_outer")


def _refreshed(spark: SparkSession, folder: str) -> tuple[refresh.Index, DataFrame]:
    """The index of the earlier captures, stored by workspace, brought up to date with those of today."""
    sources, options = samples.page_sources(spark, folder), {"splitter": "window"}
    before = samples.earlier_pages(spark, folder)
    model = embedding.fit_embedder(cut_lineage(ingest.ingest(before, sources, **options).chunks), "child_text", width=64)
    built = refresh.refresh(None, before, sources, model, **options)[0]
    tables_of = {}
    for name in ("pages", "parents", "chunks", "vectors"):
        table, path = getattr(built, name), scratch_path(spark, name)
        write_by_workspace(table, path)
        tables_of[name] = spark.read.schema(table.schema).parquet(path).select(*table.columns)
    return refresh.refresh(refresh.Index(**tables_of), samples.pages(spark, folder), sources, model, **options)


@_query
def reindex_changed(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks and vectors after an incremental run: those of a full rebuild."""
    index, _ = _refreshed(spark, folder)
    vectors = index.vectors.select(F.col("chunk_id").alias("id"), "workspace_id", "source_id", _digits().alias("embedding"))
    return index.chunks.withColumn("child_text", F.md5("child_text")).join(vectors, ["id", "workspace_id", "source_id"], "full_outer")


@_query
def reindex_work(spark: SparkSession, folder: str) -> DataFrame:
    """What the incremental run had to do, by source."""
    return _refreshed(spark, folder)[1]


# --- cleaning --------------------------------------------------------------------------------------


@_query
def extract_content(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.extract_content(samples.pages(spark, folder)).withColumn("content", F.md5("content"))


@_query
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with every line end and space made dirty."""
    dirty = F.replace(F.replace("text", F.lit("\n"), F.lit(" \r\n\t\n\n\n")), F.lit(" "), F.lit("  "))
    padded = F.concat(F.lit(" \n"), dirty, F.lit("\t　"))
    return read_table(spark, folder, "documents", spread=True).select(
        "doc_id", F.md5(text.clean_text(padded)).alias("text_md5")
    )


def _graded_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pages; a toxic one counts as failed."""
    toxic = read_table(spark, folder, "labels").where(F.col("toxic") == 1).select("doc_id").distinct()
    flagged = toxic.withColumn("failed", F.lit(True))
    return (
        read_table(spark, folder, "documents", spread=True)
        .join(flagged, "doc_id", "left")
        .select(
            "doc_id",
            F.col("source").alias("source_id"),
            F.col("lang").alias("workspace_id"),
            F.concat(F.lit("doc://"), F.col("doc_id")).alias("page_url"),
            F.col("source").alias("page_title"),
            F.col("text").alias("content"),
            F.coalesce("failed", F.lit(False)).alias("failed"),
        )
    )


@_query
def quality_gate(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.audit_pages(_graded_documents(spark, folder)).select("doc_id", "drop_reason")


@_query
def owned_by(spark: SparkSession, folder: str) -> DataFrame:
    """Every source claimed by the user whose number is its key's remainder."""
    claims = samples.sources(spark, folder).withColumn("user_id", (F.col("id").cast("long") % 25).cast("string"))
    return tables.owned_by(claims, samples.workspaces(spark, folder)).select("id", "workspace_id", "user_id")


@_query
def section_label(spark: SparkSession, folder: str) -> DataFrame:
    heading = F.when(F.col("lang") == "en", "").when(F.col("lang") != "de", F.concat("lang", F.lit(" notes")))
    return read_table(spark, folder, "documents").select(
        "doc_id", text.section_label(heading, F.col("source")).alias("section_heading")
    )


@_query
def split_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Sources by host; pages fetched without TLS have lost their article."""
    url = F.col("url")
    html = F.when(url.startswith("http:"), F.regexp_replace("html", "article", "section")).otherwise(F.col("html"))
    captured = samples.pages(spark, folder).select(urls.host(url).alias("source_id"), "url", html.alias("html"))
    return cleaning.source_outcome(cleaning.extract_content(captured))


@_query
def split_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Both outputs of the split: good pages with their content, failed ones with their URL alone."""
    url = F.col("url")
    html = F.when(url.startswith("http:"), F.regexp_replace("html", "article", "section")).otherwise(F.col("html"))
    read = cleaning.extract_content(samples.pages(spark, folder).select("page_id", "url", html.alias("html")))
    good, failed = cleaning.split_failures(read)
    return good.select("page_id", "url", F.md5("content").alias("content"), F.lit("good").alias("output")).unionByName(
        failed.select("page_id", "url", F.lit(None).cast("string").alias("content"), F.lit("failed").alias("output")))


# --- chunking --------------------------------------------------------------------------------------


@_query
def split_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of a document becomes a heading; its level depends on the language (four is none)."""
    hashes = (
        F.when(F.col("lang") == "en", "\n## ")
        .when(F.col("lang") == "fr", "\n# ")
        .when(F.col("lang") == "de", "\n###\t ")
        .otherwise("\n#### ")
    )
    pages = read_table(spark, folder, "documents", spread=True).select(
        "doc_id", F.replace("text", F.lit("\n"), hashes).alias("content")
    )
    return chunking.split_sections(pages).withColumn("text", F.md5("text"))


@_query
def recursive_split(spark: SparkSession, folder: str) -> DataFrame:
    documents = samples.page_text(spark, folder).select("page_url", "content")
    return chunking.recursive_split(documents, "content", CHILD_LEVEL)


def _cut_check(pages: DataFrame, cut: DataFrame, column: str, holder: str, size: int) -> DataFrame:
    """Per page: pieces that are too long, pieces that are not part of what they were cut from, and the page's words that pieces hold whole.

    One pass over the pieces, which are not stored, and one shuffle: of a piece or a page its distinct words go to the page's task, in one
    text, and of a piece two flags, which count on its first word's row.
    """
    words = lambda name: F.nullif(F.array_join(F.array_distinct(text.tokens(F.col(name))), " "), F.lit("")).alias("words")
    outside = ~F.coalesce(F.contains(holder, column), F.lit(False))
    pieces = cut.select("page_url", words(column), F.coalesce(F.length(column) > size, F.lit(False)).alias("long"), outside.alias("outside"), F.lit(1).alias("side"))
    whole = pages.select("page_url", words("content"), F.lit(False).alias("long"), F.lit(False).alias("outside"), F.lit(2).alias("side"))
    dealt = pieces.unionByName(whole).where("page_url IS NOT NULL").repartition("page_url")
    first = F.coalesce("at", F.lit(0)) == 0
    rows = dealt.select("page_url", "long", "outside", "side", F.posexplode_outer(F.split("words", " ")).alias("at", "word")).groupBy("page_url", "word").agg(
        F.count_if(F.col("long") & first).alias("long"), F.count_if(F.col("outside") & first).alias("outside"), F.bit_or("side").alias("sides"))
    held = F.when((F.col("sides") == 3) & F.col("word").isNotNull(), F.col("word"))
    checked = rows.groupBy("page_url").agg(
        F.sum("long").alias("n_too_long"), F.sum("outside").alias("n_outside"), F.count(held).alias("n_words"), F.collect_list(held).alias("_words"))
    return checked.where("n_words > 0").select(
        "page_url", "n_too_long", "n_outside", "n_words", F.md5(F.array_join(F.sort_array("_words"), " ")).alias("words_md5"))


@_query
def recursive_split_words(spark: SparkSession, folder: str) -> DataFrame:
    """The recursive split by its contract: chunks within their size, parts of their page, and no word of the page lost."""
    pages = samples.page_text(spark, folder).select("page_url", "content")
    chunks = chunking.recursive_split(pages.withColumn("whole", F.col("content")), "content", CHILD_LEVEL)
    return _cut_check(pages, chunks, "chunk", "whole", CHILD_LEVEL.size)


@_query
def chunk_hierarchy_recursive_words(spark: SparkSession, folder: str) -> DataFrame:
    """The same of the hierarchy: children within their size, parts of their parent, and no word of the page lost."""
    pages = samples.page_text(spark, folder)
    parents, chunks = chunking.chunk_hierarchy(pages)
    children = chunks.select("parent_id", "page_url", "child_text").join(parents.select("parent_id", "parent_text"), "parent_id", "left")
    return _cut_check(pages, children, "child_text", "parent_text", CHILD_LEVEL.size)


@_query
def window_split(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents", spread=True).select("doc_id", "text")
    return chunking.window_split(documents, "text", 300, 30).withColumn("chunk", F.md5("chunk"))


@_query
def chunk_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Sections, parents and children with character windows as the splitter."""
    parents, chunks = chunking.chunk_hierarchy(samples.page_text(spark, folder), splitter="window")
    lengths = parents.select("parent_id", F.length("parent_text").cast("long").alias("parent_length"))
    return chunks.join(lengths, "parent_id").withColumn("child_text", F.md5("child_text"))


@_query
def chunk_hierarchy_recursive(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_hierarchy(samples.page_text(spark, folder))[1]


@_query
def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Both id schemes for every document taken as one child."""
    key = [F.col("source"), F.concat(F.lit("doc://"), F.col("doc_id")), F.lit(2)]
    columns = {}
    for scheme in ids.SCHEMES:
        columns[f"parent_id_{scheme}"] = ids.parent_id(*key, F.lit(1), scheme)
        columns[f"id_{scheme}"] = ids.chunk_id(*key, F.lit(1), F.lit(3), F.col("text"), scheme)
    return read_table(spark, folder, "documents", spread=True).select(
        "doc_id", *[c.alias(name) for name, c in columns.items()]
    )


@_query
def chunk_counts(spark: SparkSession, folder: str) -> DataFrame:
    pages = cleaning.audit_pages(_graded_documents(spark, folder))
    _, chunks = chunking.chunk_hierarchy(pages.where(F.col("drop_reason").isNull()), splitter="window")
    labelled = read_table(spark, folder, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey")).alias("source_id"))
    return chunking.chunk_counts(labelled, pages, chunks)


# --- embedding -------------------------------------------------------------------------------------


@_query
def embed_texts(spark: SparkSession, folder: str) -> DataFrame:
    chunks = samples.search_chunks(spark, folder).select("id", "child_text")
    model = embedding.fit_embedder(chunks, "child_text")
    return embedding.embed_texts(chunks, "child_text", model).select(
        "id", F.size("embedding").cast("long").alias("width"), _digits().alias("embedding")
    )


@_query
def attach_vectors(spark: SparkSession, folder: str) -> DataFrame:
    chunks = samples.search_chunks(spark, folder).select("id", "workspace_id")
    paired, missing = embedding.attach_vectors(chunks, samples.search_vectors(spark, folder))
    width = F.size("embedding").cast("long")
    return paired.select("id", "workspace_id", width.alias("width")).unionByName(
        missing.select("id", "workspace_id", F.lit(0).cast("long").alias("width"))
    )


# --- retrieval -------------------------------------------------------------------------------------


@_query
def keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    return keyword.keyword_search(
        samples.search_chunks(spark, folder), samples.questions(spark, folder), analyzer="simple"
    ).drop("workspace_id")


@_query
def keyword_search_english(spark: SparkSession, folder: str) -> DataFrame:
    return keyword.keyword_search(samples.search_chunks(spark, folder), samples.questions(spark, folder)).drop("workspace_id")


@_query
def keyword_search_postings(spark: SparkSession, folder: str) -> DataFrame:
    """The same answers from a written postings table."""
    path = scratch_path(spark, "postings")
    keyword.write_postings(keyword.build_postings(samples.search_chunks(spark, folder), "simple"), path)
    return keyword.keyword_search_postings(
        keyword.read_postings(spark, path), samples.questions(spark, folder), analyzer="simple"
    ).drop("workspace_id")


@_query
def vector_search(spark: SparkSession, folder: str) -> DataFrame:
    return vector.vector_search(samples.search_vectors(spark, folder), samples.questions(spark, folder)).drop("workspace_id")


@_query
def vector_search_approximate(spark: SparkSession, folder: str) -> DataFrame:
    """By way of the 8-bit index, written as a table; the same rows as those of the exact search."""
    vectors, path = samples.search_vectors(spark, folder), scratch_path(spark, "codes")
    write_by_workspace(vector.code_vectors(vectors), path)
    codes = spark.read.schema(vector.CODES).parquet(path)
    return vector.coded_vector_search(vectors, samples.questions(spark, folder), codes=codes).drop("workspace_id")


@_query
def vector_index_quality(spark: SparkSession, folder: str) -> DataFrame:
    """True neighbours, those that the index finds, the exact search's products, and whether the index makes a fifth of them or less."""
    vectors, asked = samples.search_vectors(spark, folder), cut_lineage(samples.questions(spark, folder))
    keys = ["workspace_id", "question_id", "id"]
    found = vector.coded_vector_search(vectors, asked).select(*keys, F.lit(1).alias("hit"))
    recall = vector.vector_search(vectors, asked).join(found, keys, "left").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"))
    share = vector.candidate_share(vectors, asked)
    few = F.col("candidates") <= 0.2 * F.col("products")
    return recall.crossJoin(share.select(F.col("products").alias("n_products"), few.alias("fifth_or_less")))


def _fused(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.fused_hits(
        samples.search_chunks(spark, folder),
        samples.search_vectors(spark, folder),
        samples.questions(spark, folder),
        analyzer="simple",
    )


@_query
def tenant_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Customers' sources: those of the workspaces of which some owner is in debt."""
    owing = read_table(spark, folder, "customer").where("c_acctbal < 0")
    asked = owing.select(F.col("c_custkey").cast("string").alias("workspace_id"))
    return tables.tenant_filter(samples.sources(spark, folder).select("id", "workspace_id"), asked)


@_query
def overfetch(spark: SparkSession, folder: str) -> DataFrame:
    """Both lists of the hybrid search before they are fused."""
    lists = retrieval.overfetched(
        samples.search_chunks(spark, folder),
        samples.search_vectors(spark, folder),
        samples.questions(spark, folder),
        analyzer="simple",
    )
    by_vector, by_keyword = (
        hits.withColumn("list", F.lit(name)) for name, hits in zip(("vector", "keyword"), lists, strict=True)
    )
    return by_vector.unionByName(by_keyword).drop("workspace_id")


@_query
def rrf_fuse(spark: SparkSession, folder: str) -> DataFrame:
    return _fused(spark, folder).drop("workspace_id")


@_query
def confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Threshold 0.02 tells hits of one list from hits of both."""
    return fusion.confidence(samples.questions(spark, folder), _fused(spark, folder), 0.02)


@_query
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    hits = retrieval.hybrid_search(
        samples.search_chunks(spark, folder),
        samples.search_vectors(spark, folder),
        samples.questions(spark, folder),
        analyzer="simple",
    )
    return hits.withColumn("child_text", F.md5("child_text")).drop("workspace_id")


@_query
def parent_context(spark: SparkSession, folder: str) -> DataFrame:
    chunks = samples.search_chunks(spark, folder)
    parents = read_table(spark, folder, "documents").groupBy(F.md5("source").alias("parent_id")).agg(
        F.min("source").alias("parent_text")
    )
    return fusion.parent_context(cut_lineage(_fused(spark, folder)), chunks, parents)


@_query
def answer_pages(spark: SparkSession, folder: str) -> DataFrame:
    """From html to answers: all pages are indexed and embedded, then every page's title is asked in its workspace.

    A row per question and parent context, with the question's verdict.
    """
    pages = samples.pages(spark, folder)
    done = ingest.ingest(pages, samples.page_sources(spark, folder), splitter="window")
    chunks, parents = cut_lineage(done.chunks), cut_lineage(done.parents)
    model = embedding.fit_embedder(chunks, "child_text", width=64)
    vectors = cut_lineage(ingest.embed_chunks(chunks, model))
    room = F.regexp_extract(urls.registrable_domain(urls.host(F.col("url"))), r"([^.]+)$", 1)
    questions = cleaning.extract_content(pages).select(F.col("page_id").cast("string").alias("question_id"), room.alias("workspace_id"), F.col("title").alias("text"))
    _, contexts, verdicts = retrieval.ask(chunks, parents, vectors, questions, model, threshold=0.02, analyzer="simple")
    return verdicts.join(contexts.withColumn("parent_text", F.md5("parent_text")), "question_id", "left")


# --- reports ---------------------------------------------------------------------------------------


@_query
def workspace_list(spark: SparkSession, folder: str) -> DataFrame:
    return reports.workspace_list(samples.workspaces(spark, folder), samples.sources(spark, folder))


@_query
def workspace_messages(spark: SparkSession, folder: str) -> DataFrame:
    return reports.message_counts(samples.workspaces(spark, folder), samples.messages(spark, folder))


@_query
def workspace_detail(spark: SparkSession, folder: str) -> DataFrame:
    """Each workspace asked for by a user whose number is the workspace's remainder."""
    spaces = samples.workspaces(spark, folder)
    asked = spaces.select("id", (F.col("id").cast("long") % 25).cast("string").alias("user_id"))
    return reports.workspace_detail(spaces, samples.sources(spark, folder), asked)


@_query
def source_list(spark: SparkSession, folder: str) -> DataFrame:
    spaces = samples.workspaces(spark, folder)
    asked = spaces.select(F.col("id").alias("workspace_id"), (F.col("id").cast("long") % 25).cast("string").alias("user_id"))
    return reports.source_list(samples.sources(spark, folder), spaces, asked)


# --- streams ---------------------------------------------------------------------------------------


def _stream(spark: SparkSession, folder: str, table: str, schema: str, by: str) -> DataFrame:
    """A table, dealt in its order over four files, as a stream that takes one file at a time."""
    path = scratch_path(spark, f"{table}-files")
    read_table(spark, folder, table).repartitionByRange(4, by).write.parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _stream_in_order(spark: SparkSession, folder: str, table: str, schema: str, by: str) -> DataFrame:
    """The same with files written one after the other, as the source takes them by age: no row comes late."""
    path, rows = scratch_path(spark, f"{table}-files"), read_table(spark, folder, table)
    low, high = rows.agg(F.min(by), F.max(by)).first()
    part = F.floor((F.col(by) - F.lit(low or 0)) * 4 / F.lit((high or 0) - (low or 0) + 1))
    for k in range(4):
        rows.where(part == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(stream: DataFrame, spark: SparkSession, name: str, schema: str, **options) -> DataFrame:
    path = scratch_path(spark, name)
    write_epochs(stream, path, scratch_path(spark, f"{name}-progress"), **options).awaitTermination()
    return read_epochs(spark, path, schema)


def _ingested(spark: SparkSession, folder: str) -> str:
    path = scratch_path(spark, "chunks")
    pages = _stream(spark, folder, "pages", PAGES, "page_id")
    sources = samples.page_sources(spark, folder)
    stream_tables.stream_chunks(
        pages, sources, path, scratch_path(spark, "chunks-progress"), splitter="window"
    ).awaitTermination()
    return path


@_query
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    chunks = stream_tables.current_chunks(spark, _ingested(spark, folder))
    return chunks.withColumn("child_text", F.md5("child_text"))


@_query
def stream_ingest_status(spark: SparkSession, folder: str) -> DataFrame:
    """Sources after all micro-batches, and how many stage events of each kind they had."""
    path = _ingested(spark, folder)
    events = stream_tables.stage_events(spark, path).groupBy("source_id").agg(
        F.sum(F.when(F.col("status") == "SCRAPING", F.col("n"))).alias("n_scraped"),
        F.count_if(F.col("status").isin("DONE", "FAILED")).alias("n_ends"), F.count_if(F.col("status") == "SCRAPING").alias("n_starts"))
    outcome = cleaning.source_outcome(stream_tables.current_pages(spark, path))
    return outcome.join(events, "source_id").select("source_id", "n_pages", "n_failed", "status", "error", "n_scraped",
                                                    (F.col("n_ends") == F.col("n_starts")).alias("all_ended"))


@_query
def stream_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The second stage: chunks of the first are embedded as they come; every current chunk has its vector."""
    path, vectors = _ingested(spark, folder), scratch_path(spark, "vectors")
    chunks = cut_lineage(stream_tables.current_chunks(spark, path))
    model = embedding.fit_embedder(chunks, "child_text", width=64)
    stream_tables.stream_vectors(path, spark, model, vectors, scratch_path(spark, "vectors-progress")).awaitTermination()
    current = stream_tables.current_vectors(spark, vectors, chunks)
    return current.select("chunk_id", "workspace_id", "source_id", _digits().alias("embedding"))


@_query
def stream_stages(spark: SparkSession, folder: str) -> DataFrame:
    """Events as pages of their user: errors failed, sign-ups are too short, clicks and purchases have chunks. Six quiet hours end a run."""
    kind = F.col("event_type")
    pages = _stream_in_order(spark, folder, "events", EVENTS, "event_id").select(
        F.col("user_id").cast("string").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"), (kind == "error").alias("failed"),
        F.when(kind == "signup", "short").alias("drop_reason"), F.when(kind.isin("click", "purchase"), F.floor(F.abs("value")) + 1).alias("n_chunks"))
    log = "source_id STRING, run BIGINT, step INT, status STRING, pages BIGINT, chunks BIGINT, error STRING, ts TIMESTAMP"
    return _run(stages.source_stages(pages, "1 hour", 6 * 3600), spark, "stages", log).drop("epoch")


@_query
def stream_dedup_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Sign-ups are requests; the horizon is longer than the data, so each source is queued once."""
    events = samples.status_events(_stream(spark, folder, "events", EVENTS, "event_id"))
    requests = events.where(F.col("status") == "PENDING").select("source_id", "ts")
    queued = stream_status.dedup_requests(requests, "60 days")
    return _run(queued, spark, "requests", "source_id STRING, ts TIMESTAMP").select("source_id")


@_query
def stream_request_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Sign-ups are requests; two quiet days end a source's run, so sources return and their state expires."""
    events = samples.status_events(_stream_in_order(spark, folder, "events", EVENTS, "event_id"))
    requests = events.where(F.col("status") == "PENDING").select("source_id", "ts")
    log = "source_id STRING, first_ts TIMESTAMP, last_ts TIMESTAMP, n_requests BIGINT"
    return _run(stream_status.request_runs(requests, "1 hour", "2 days"), spark, "runs", log).drop("epoch")


@_query
def stream_status_latest(spark: SparkSession, folder: str) -> DataFrame:
    latest = stream_status.status_latest(samples.status_events(_stream(spark, folder, "events", EVENTS, "event_id")))
    log = _run(latest, spark, "status", "source_id STRING, status STRING, ts TIMESTAMP", mode="update")
    return latest_by(log, "source_id")


@_query
def stream_status_route(spark: SparkSession, folder: str) -> DataFrame:
    """Events as JSON messages: errors go to another channel and some purchases are broken off."""
    events = samples.status_events(_stream(spark, folder, "events", EVENTS, "event_id"))
    message = F.to_json(
        F.struct(
            F.col("workspace_id").alias("workspaceId"),
            F.col("source_id").alias("sourceId"),
            "status",
            F.col("event_id").cast("int").alias("pageCount"),
            F.lit("extra").alias("note"),
        )
    )
    broken = (F.col("status") == "DONE") & (F.col("event_id") % 2 == 0)
    messages = events.select(
        F.when(F.col("status") == "FAILED", "source:other").otherwise("source:status").alias("channel"),
        F.when(broken, F.substr(message, F.lit(1), F.lit(20))).otherwise(message).alias("value"),
    )
    rooms = read_table(spark, folder, "nation").select(
        F.col("n_regionkey").cast("string").alias("workspace_id"), F.col("n_name").alias("user_id")
    )
    routed = stream_status.status_route(messages, rooms)
    fields = "workspace_id STRING, user_id STRING, source_id STRING, status STRING, page_count INT, chunk_count INT, error STRING"
    return _run(routed, spark, "routed", fields).drop("epoch")


@_query
def stream_page_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Good pages per host; pages fetched without TLS have lost their article."""
    url = F.col("url")
    html = F.when(url.startswith("http:"), F.regexp_replace("html", "article", "section")).otherwise(F.col("html"))
    pages = _stream(spark, folder, "pages", PAGES, "page_id").select(urls.host(url).alias("source_id"), "url", html.alias("html"))
    counted = stream_status.page_progress(cleaning.extract_content(pages))
    return latest_by(_run(counted, spark, "progress", "source_id STRING, page_count BIGINT", mode="update"), "source_id")
