"""The registered queries in plain SQL, for a side-by-side check by another engine."""

from __future__ import annotations

from gleanloom.functions.html import BLOCK_TAGS, DROPPED_ELEMENTS, ENTITIES
from gleanloom.functions.text import TOKEN_PATTERN, WHITE_SPACE, WHITE_SPACE_CLASS
from gleanloom.functions.urls import DOMAIN, HOST, SKIPPED_PARTS

# Content patterns in the form of the contract, for an engine whose matcher is linear.
TAG = r"</?[A-Za-z!][^<>]*>"
TITLE = r"(?is)<title(?:\s[^<>]*)?>(.*?)</title\s*>"
ARTICLE = r"(?is)<article(?:\s[^<>]*)?>(.*?)</article\s*>"
MAIN = r"(?is)<main(?:\s[^<>]*)?>(.*?)</main\s*>"
DROPPED = (
    r"(?is)<!--.*?-->|"
    + "|".join(rf"<{name}(?:\s[^<>]*)?>.*?</{name}\s*>" for name in DROPPED_ELEMENTS)
    + r"""|<div\s[^<>]*class=["']?(?:ad|ads|advert)\b[^<>]*>.*?</div\s*>"""
)
OUTSIDE_BODY = r"(?is)<head(?:\s[^<>]*)?>.*?</head\s*>|<!doctype[^<>]*>"
LINE_ENDS = rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})(?:\s[^<>]*)?/?>"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _trim(x: str) -> str:
    return f"trim({x}, {_quoted(WHITE_SPACE)})"


def _drop(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {_quoted(pattern)}, {_quoted(by)}, 'g')"


def _clean(x: str) -> str:
    x = f"replace({x}, chr(13) || chr(10), chr(10))"
    x = f"replace({x}, chr(9), ' ')"
    x = _drop(x, " {2,}", " ")
    return _trim(_drop(x, "\n{3,}", "\n\n"))


def _decode(x: str) -> str:
    for entity, char in ENTITIES.items():
        x = f"replace({x}, {_quoted(entity)}, {_quoted(char)})"
    return x


def _host(url: str) -> str:
    return f"lower(nullif(regexp_extract({url}, {_quoted(HOST)}, 1), ''))"


def _path(url: str) -> str:
    return f"coalesce(nullif(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), ''), '/')"


def _domain(url: str) -> str:
    return f"regexp_extract({_host(url)}, '{DOMAIN}')"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{TOKEN_PATTERN}', 1)"


def _extracted(pages: str) -> str:
    """SELECT of url, title, content, failed and the other columns of ``pages``."""
    lined = _drop("coalesce(found, regexp_replace(kept, {0}, '', 'g'))".format(_quoted(OUTSIDE_BODY)), LINE_ENDS, "\n")
    title = _decode(_drop(f"regexp_extract(html, '{TITLE}', 1)", TAG))
    return f"""
      SELECT * EXCLUDE (html, kept, found),
        {_trim(title)} AS title,
        {_clean(_decode(_drop(lined, TAG)))} AS content,
        found IS NULL AS failed
      FROM (
        SELECT *, coalesce(nullif(regexp_extract(kept, '{ARTICLE}', 1), ''),
                           nullif(regexp_extract(kept, '{MAIN}', 1), '')) AS found
        FROM (SELECT *, {_drop("html", DROPPED)} AS kept FROM ({pages})))"""


def _sections(pages: str, keep: str) -> str:
    """Rows (keep, section_index, heading, part) of ``pages`` with a ``content`` column."""
    heading = rf"#{{1,3}}{WHITE_SPACE_CLASS}+.+"
    marked = f"regexp_replace(replace(content, chr(1), ''), '(?m)^({heading})$', chr(1) || '\\1', 'g')"
    title = rf"(?m)^#{{1,3}}{WHITE_SPACE_CLASS}+(.+)$"
    return f"""
      SELECT {keep}, section_index, {_trim("part")} AS text,
        CASE WHEN section_index = 0 AND NOT starts_with(marked, chr(1)) THEN ''
             ELSE regexp_extract(part, '{title}', 1) END AS heading
      FROM (
        SELECT {keep}, marked, unnest(parts) AS part, unnest(range(len(parts))) AS section_index
        FROM (SELECT *, list_filter(string_split(marked, chr(1)), lambda p: p <> '') AS parts
              FROM (SELECT *, {marked} AS marked FROM ({pages}))))"""


def _windows(x: str, size: int, overlap: int) -> str:
    starts = f"range(1, greatest(length({x}) - {overlap}, 1) + 1, {size - overlap})"
    cut = f"list_transform({starts}, lambda w: {_trim(f'substr({x}, w, {size})')})"
    return f"list_filter({cut}, lambda w: w <> '')"


def _hierarchy(pages: str) -> str:
    """Children by character windows of ``pages`` (source_id, workspace_id, page_url, page_title, content)."""
    keep = "source_id, workspace_id, page_url, page_title"
    where = f"SELECT {keep}, content FROM ({pages}) WHERE length(content) >= 50"
    return f"""
      SELECT md5(concat_ws('-', source_id, page_url, section_index, parent_index, chunk_index, child_text)) AS id,
        md5(concat_ws('-', source_id, page_url, section_index, 'parent', parent_index)) AS parent_id,
        {keep}, section_index::INTEGER AS section_index, coalesce(nullif(heading, ''), page_title) AS section_heading,
        parent_index::INTEGER AS parent_index, chunk_index::INTEGER AS chunk_index, child_text, parent_text
      FROM (
        SELECT *, unnest(children) AS child_text, unnest(range(len(children))) AS chunk_index
        FROM (
          SELECT *, {_windows("parent_text", 300, 30)} AS children
          FROM (
            SELECT *, unnest(parents) AS parent_text, unnest(range(len(parents))) AS parent_index
            FROM (SELECT *, {_windows("text", 1500, 100)} AS parents
                  FROM ({_sections(where, keep)}) WHERE length(text) >= 30))))"""


_WORKSPACES = """
  SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS description,
    c_nationkey::VARCHAR AS user_id, first_order AS created_at
  FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY 1)
    ON c_custkey = o_custkey"""

_SOURCES = """
  SELECT o_orderkey::VARCHAR AS id,
    'https://site.example.com/' || regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '-', 'g') AS url,
    o_custkey::VARCHAR AS workspace_id,
    CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'FAILED' ELSE 'DONE' END AS status,
    7 AS page_count, 70 AS chunk_count, CASE WHEN o_orderstatus = 'P' THEN 'timeout' END AS error,
    o_orderdate AS created_at
  FROM orders"""

_MESSAGES = """
  SELECT concat_ws('-', l_orderkey, l_linenumber) AS id, o_custkey::VARCHAR AS workspace_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

_REQUESTS = f"""
  SELECT s.id, CASE WHEN s.url LIKE '%/5-LOW' THEN 'site.example.com/5-LOW' ELSE s.url END AS url, s.workspace_id,
    CASE WHEN s.url LIKE '%/1-URGENT' THEN (w.user_id::INT + 1)::VARCHAR ELSE w.user_id END AS user_id, s.created_at
  FROM ({_SOURCES}) s JOIN ({_WORKSPACES}) w ON s.workspace_id = w.id WHERE s.status <> 'DONE'"""

_CHUNKS = """
  SELECT doc_id::VARCHAR AS id, lang AS workspace_id, source AS source_id, 'doc://' || doc_id AS page_url,
    source AS page_title, '' AS section_heading, text AS child_text, md5(source) AS parent_id
  FROM documents"""

_VECTORS = """
  SELECT vec_id::VARCHAR AS chunk_id, coalesce(lang, 'stray') AS workspace_id, coalesce(source, 'stray') AS source_id, embedding
  FROM embeddings LEFT JOIN documents ON doc_id = vec_id"""

_PAGES_AS_DOCUMENTS = """
  SELECT source AS source_id, lang AS workspace_id, 'doc://' || doc_id AS page_url, source AS page_title,
    '# ' || source || chr(10) || text AS content
  FROM documents"""

_GRADED = """
  SELECT doc_id, source AS source_id, lang AS workspace_id, 'doc://' || doc_id AS page_url, source AS page_title,
    text AS content, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS failed
  FROM documents"""

_DROP_REASON = """CASE WHEN failed THEN 'failed' WHEN coalesce(length(content), 0) = 0 THEN 'empty'
    WHEN length(content) <= 100 THEN 'short' END"""

_LINKS = f"""
  SELECT page_id, src, href,
    CASE WHEN trim(link) = '' THEN NULL
         WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link
         WHEN starts_with(link, '//') THEN regexp_extract(src, '^[A-Za-z][A-Za-z0-9+.-]*:') || link
         WHEN starts_with(link, '/') THEN regexp_extract(src, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') || link
         WHEN starts_with(link, '?') THEN regexp_extract(src, '^[^?#]*') || link
         WHEN starts_with(link, '#') THEN regexp_extract(src, '^[^#]*') || link
         ELSE regexp_extract(src, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')
              || regexp_replace({_path("src")}, '[^/]*$', '') || link END AS dst
  FROM (SELECT page_id, src, href, replace(href, '&amp;', '&') AS link
        FROM (SELECT page_id, url AS src,
                unnest(regexp_extract_all(
                  regexp_replace(html, '(?is)<!--.*?-->|<script(?:\\s[^<>]*)?>.*?</script\\s*>|<style(?:\\s[^<>]*)?>.*?</style\\s*>', '', 'g'),
                  '(?i)<a\\s(?:[^<>]*\\s)?href\\s*=\\s*["'']([^"''<>]+)["'']', 1)) AS href FROM pages))
  WHERE trim(link) <> ''"""

_QUESTIONS = f"""
  known AS (
    SELECT concat_ws('-', item_id, position) AS question_id, coalesce(lang, 'stray') AS workspace_id,
      words[position + 1] || ' ' || words[position + 2] AS text, embedding
    FROM (SELECT item_id, words, unnest(range(len(words) - 1)) AS position
          FROM (SELECT item_id, {_tokens("text")} AS words FROM benchmark))
    JOIN embeddings ON vec_id = item_id LEFT JOIN documents ON doc_id = item_id),
  questions AS (
    SELECT * FROM known UNION ALL
    SELECT 'none', 'xx', text, embedding FROM known WHERE question_id = '0-0')"""

_CTES_KEYWORD = f"""
  words AS (
    SELECT workspace_id, id, unnest(tokens) AS term, unnest(range(len(tokens))) AS position
    FROM (SELECT workspace_id, id, {_tokens("child_text || ' ' || page_title || ' ' || section_heading")} AS tokens
          FROM ({_CHUNKS}))),
  asked AS (
    SELECT question_id, workspace_id, unnest(list_distinct({_tokens("text")})) AS term FROM questions),
  asked_n AS (SELECT *, count(*) OVER (PARTITION BY question_id) AS n_terms FROM asked),
  postings AS (
    SELECT workspace_id, term, id, list(position) AS positions FROM words
    WHERE (workspace_id, term) IN (SELECT workspace_id, term FROM asked) GROUP BY 1, 2, 3),
  matched AS (
    SELECT question_id, id, n_terms FROM asked_n JOIN postings USING (workspace_id, term)
    GROUP BY 1, 2, 3 HAVING count(*) = n_terms),
  hits AS (
    SELECT question_id, id, term, n_terms, positions
    FROM matched JOIN asked_n USING (question_id, n_terms) JOIN postings USING (workspace_id, term, id)),
  single AS (
    SELECT question_id, id,
      round(0.1::DOUBLE * list_sum(list_transform(range(1, len(positions) + 1), lambda j: 1.0::DOUBLE / (j * j)))
            / 1.64493406685::DOUBLE, 6) AS score
    FROM hits WHERE n_terms = 1),
  spread AS (SELECT question_id, id, term, unnest(positions) AS position FROM hits WHERE n_terms > 1),
  near AS (
    SELECT a.question_id, a.id,
      sum(ln(1 - 0.1::DOUBLE / sqrt(1.005::DOUBLE
        + 0.05::DOUBLE * exp(abs(a.position - b.position) / 1.5::DOUBLE - 2)))) AS log_miss
    FROM spread a JOIN spread b ON a.question_id = b.question_id AND a.id = b.id AND a.term < b.term
      AND abs(a.position - b.position) <= 100
    GROUP BY 1, 2),
  ranked AS (
    SELECT question_id, id, score FROM single
    UNION ALL
    SELECT question_id, id, round(1 - exp(coalesce(log_miss, 0)), 6)
    FROM matched LEFT JOIN near USING (question_id, id) WHERE n_terms > 1),
  keyword AS (
    SELECT question_id, id, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) - 1 AS rank FROM ranked)
    WHERE rank < 10)"""

_CTES_VECTOR = f"""
  scored AS (
    SELECT question_id, chunk_id AS id,
      round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) + 0.0 AS score
    FROM questions q JOIN ({_VECTORS}) v USING (workspace_id)),
  vector AS (
    SELECT question_id, id, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) - 1 AS rank FROM scored)
    WHERE rank < 10)"""

_CTES_FUSED = """
  fused AS (
    SELECT question_id, id, round(total, 6) AS score, rank, in_vector, in_keyword FROM (
      SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY total DESC, rv NULLS LAST, rk) - 1 AS rank
      FROM (
        SELECT question_id, id, v.rank AS rv, k.rank AS rk,
          coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + k.rank), 0) AS total,
          v.rank IS NOT NULL AS in_vector, k.rank IS NOT NULL AS in_keyword
        FROM vector v FULL JOIN keyword k USING (question_id, id)))
    WHERE rank < 5)"""

_WITH_FUSED = f"WITH {_QUESTIONS}, {_CTES_KEYWORD}, {_CTES_VECTOR}, {_CTES_FUSED}"

_PATCH_ORDER = (
    "l_linenumber * 1000000000000000000 + round(l_extendedprice * 100)::BIGINT * 1000000000"
    " + l_partkey * 10000 + l_suppkey"
)

_STATUS_EVENTS = """
  SELECT event_id, user_id::VARCHAR AS source_id, (user_id % 10)::VARCHAR AS workspace_id,
    CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'SCRAPING' WHEN 'click' THEN 'CHUNKING'
      WHEN 'purchase' THEN 'DONE' ELSE 'FAILED' END AS status, ts
  FROM events"""

_PAGES_BY_HOST = f"""
  SELECT {_host("url")} AS source_id, url,
    CASE WHEN starts_with(url, 'http:') THEN replace(html, 'article', 'section') ELSE html END AS html
  FROM pages"""


_DIGITS = "md5(array_to_string(list_transform(embedding, lambda x: floor(x::DOUBLE * 1000000::DOUBLE + 0.5::DOUBLE)::BIGINT), ','))"

_MERGED_VECTORS = f"""
  SELECT chunk_id, workspace_id, source_id, CASE WHEN chunk_id IN (SELECT doc_id::VARCHAR FROM labels)
    THEN list_reverse(embedding) ELSE embedding END AS embedding FROM ({_VECTORS})
  UNION ALL
  SELECT 'copy-' || chunk_id, 'copies', 'copy', embedding FROM ({_VECTORS})"""


def _embedding(name: str, rows: str, corpus: str, width: int) -> str:
    """CTE ``name`` (id, embedding) of ``rows`` (id, text) with the weights of the texts of ``corpus``."""
    bucket = f"(('0x' || substr(md5(term), 1, 8))::BIGINT % {width})"
    count = "SELECT id, {b} AS bucket, count(*) AS n FROM (SELECT id, unnest({t}) AS term FROM ({r})) GROUP BY 1, 2"
    return f"""
  {name}_corpus AS MATERIALIZED ({count.format(b=bucket, t=_tokens("text"), r=corpus)}),
  {name}_df AS (SELECT bucket, ln(((SELECT count(*) FROM ({corpus})) + 1)::DOUBLE / (count(*) + 1)) AS idf FROM {name}_corpus GROUP BY 1),
  {name}_none AS (SELECT ln((SELECT count(*) FROM ({corpus})) + 1::DOUBLE) AS idf),
  {name}_weights AS (
    SELECT id, bucket, n * coalesce(idf, (SELECT idf FROM {name}_none)) AS weight
    FROM ({count.format(b=bucket, t=_tokens("text"), r=rows)}) LEFT JOIN {name}_df USING (bucket)),
  {name}_norms AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM {name}_weights GROUP BY 1),
  {name} AS (
    SELECT r.id, list(coalesce(weight / nullif(norm, 0), 0)::FLOAT ORDER BY k) AS embedding
    FROM ({rows}) r CROSS JOIN (SELECT unnest(range({width})) AS k) LEFT JOIN {name}_weights w ON w.id = r.id AND bucket = k
    LEFT JOIN {name}_norms o ON o.id = r.id GROUP BY r.id)"""


def _answers() -> str:
    """Titles asked over the indexed pages, with the searches' own steps over other tables."""
    room = f"regexp_extract({_domain('url')}, '([^.]+)$', 1)"
    titles = f"SELECT page_id::VARCHAR AS id, workspace_id, title AS text FROM ({_extracted(f'SELECT page_id, {room} AS workspace_id, url, html FROM pages')})"
    corpus = "SELECT id, child_text AS text FROM page_chunks"
    keyword = _CTES_KEYWORD.replace(_CHUNKS, "SELECT * FROM page_chunks")
    vectors = "SELECT e.id AS chunk_id, workspace_id, embedding FROM chunk_vectors e JOIN page_chunks c ON c.id = e.id"
    return f"""
      WITH page_chunks AS MATERIALIZED ({_hierarchy(_file_pages())}),
      titles AS MATERIALIZED ({titles}),
      {_embedding("chunk_vectors", corpus, corpus, 64)},
      {_embedding("title_vectors", "SELECT id, text FROM titles", corpus, 64)},
      questions AS (SELECT id AS question_id, workspace_id, text, embedding FROM titles JOIN title_vectors USING (id)),
      {keyword}, {_CTES_VECTOR.replace(_VECTORS, vectors)}, {_CTES_FUSED},
      contexts AS (
        SELECT question_id, parent_id, min(rank) AS rank, max(score) AS score, count(*) AS n_children, any_value(md5(parent_text)) AS parent_text
        FROM fused JOIN page_chunks USING (id) GROUP BY 1, 2),
      verdicts AS (
        SELECT question_id, count(f.id) AS n_hits, max(f.score) AS top_score, coalesce(max(f.score) >= 0.02, false) AS confident,
          CASE WHEN max(f.score) IS NULL THEN 'none' WHEN max(f.score) < 0.02 THEN 'low' END AS reason
        FROM questions LEFT JOIN fused f USING (question_id) GROUP BY 1)
      SELECT * FROM verdicts LEFT JOIN contexts USING (question_id)"""


_SITE = "'https://shop.example.com/'"

_SHOP_LINKS = f"""
  SELECT {_SITE} || 'customers/' || o_custkey AS src, {_SITE} || 'orders/' || o_orderkey AS dst FROM orders
  UNION ALL SELECT {_SITE} || 'orders/' || l_orderkey, {_SITE} || 'parts/' || l_partkey FROM lineitem
  UNION ALL SELECT {_SITE} || 'parts/' || l_partkey, {_SITE} || 'orders/' || l_orderkey FROM lineitem"""

_SHOP_ROOTS = f"SELECT c_custkey::VARCHAR AS source_id, {_SITE} || 'customers/' || c_custkey AS url FROM customer"

# Pages of the nations' site that say too little.
_THIN = f"""
  SELECT {_SITE} || 'orders/' || o_orderkey AS url FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT {_SITE} || 'parts/' || p_partkey FROM part WHERE p_size < 8
  UNION ALL SELECT {_SITE} || 'customers/' || c_custkey FROM customer WHERE c_acctbal < 0"""

_NATION_LINKS = f"""
  SELECT * FROM ({_SHOP_LINKS}
    UNION ALL SELECT {_SITE} || '?nation=' || c_nationkey, {_SITE} || 'customers/' || c_custkey FROM customer)"""

_NATION_ROOTS = f"SELECT DISTINCT c_nationkey::VARCHAR AS source_id, {_SITE} || '?nation=' || c_nationkey AS url FROM customer"


def _reachable(levels: int, links: str = _SHOP_LINKS, roots: str = _SHOP_ROOTS, limit: int = 100) -> str:
    """Level by level, each expanding only the sources that have fewer than ``limit`` pages so far."""
    sql = f"""
    WITH links AS MATERIALIZED (SELECT DISTINCT * FROM ({links})),
    s0 AS MATERIALIZED (SELECT source_id, url, 0 AS depth FROM ({roots}))"""
    for n in range(1, levels + 1):
        p = n - 1
        sql += f""",
    s{n} AS MATERIALIZED (
      SELECT * FROM s{p} UNION ALL
      SELECT source_id, url, {n} FROM (
        SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY url) AS place FROM (
          SELECT DISTINCT f.source_id, dst AS url, taken
          FROM s{p} f JOIN links ON f.url = src
          JOIN (SELECT source_id, count(*) AS taken FROM s{p} GROUP BY 1 HAVING count(*) < {limit}) USING (source_id)
          WHERE depth = {p} AND (f.source_id, dst) NOT IN (SELECT (source_id, url) FROM s{p})))
      WHERE place <= {limit} - taken)"""
    return f"{sql} SELECT source_id, url, depth FROM s{levels}"


def _file_pages(pages: str = "pages") -> str:
    """Pages of the three domain sources, ready to be cut."""
    extracted = _extracted(
        f"""SELECT 'src-' || {_domain("url")} AS source_id,
              regexp_extract({_domain("url")}, '([^.]+)$', 1) AS workspace_id, url AS page_url, html FROM {pages}"""
    )
    return f"""SELECT source_id, workspace_id, page_url, title AS page_title, content FROM ({extracted})
               WHERE NOT failed AND length(content) > 100"""


def _kept_words(pages: str) -> str:
    """What a faultless cut of the pages shows: nothing too long or foreign, and all of a page's words."""
    return f"""
      SELECT page_url, 0 AS n_too_long, 0 AS n_outside, len(words) AS n_words, md5(array_to_string(words, ' ')) AS words_md5
      FROM (SELECT page_url, list_sort(list_distinct({_tokens("content")})) AS words FROM ({pages}))"""


_EARLIER_PAGES = """
  SELECT page_id, CASE WHEN substr(md5(url), 1, 1) = '2' THEN url || '/before' ELSE url END AS url,
    CASE WHEN substr(md5(url), 1, 1) IN ('0', '1')
      THEN replace(html, '</article>', '<p>An earlier notice, since taken down by its author.</p></article>') ELSE html END AS html
  FROM pages"""


def all_oracles() -> dict[str, str]:
    skipped = "|".join(p.replace(".", "\\.") for p in SKIPPED_PARTS)
    hierarchy_columns = """id, parent_id, source_id, workspace_id, page_url, page_title, section_index,
      section_heading, parent_index, chunk_index, md5(child_text) AS child_text"""
    dirty = "replace(replace(text, chr(10), ' ' || chr(13) || chr(10) || chr(9) || repeat(chr(10), 3)), ' ', '  ')"
    dirty = f"' ' || chr(10) || {dirty} || chr(9) || chr(12288)"
    return {
        "scan_pages": """
          SELECT page_id, url, md5(html) AS html_md5 FROM (
            SELECT page_id, html, regexp_extract(url, '^[a-z]+://[^/]+') AS url FROM pages)
          QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1""",
        "extract_links": _LINKS,
        "filter_links": f"""
          SELECT * FROM (
            SELECT page_id, src, dst, substr({_path("src")}, 1, 2) AS root_path FROM (
              SELECT page_id, src, dst FROM ({_LINKS}) UNION ALL SELECT page_id, url, url FROM pages))
          WHERE starts_with({_path("dst")}, root_path) AND NOT regexp_matches(dst, {_quoted(skipped)})""",
        "scope_pages": f"""
          SELECT page_id, url, source_id, root_path
          FROM (SELECT page_id, url, {_domain("url")} AS domain FROM pages) JOIN (
            SELECT DISTINCT {_domain("url")} AS domain,
              concat_ws('/', {_domain("url")}, regexp_extract({_path("url")}, '^/([^/]*)', 1)) AS source_id,
              '/' || regexp_extract({_path("url")}, '^/([^/]*)', 1) AS root_path FROM pages) USING (domain)
          WHERE starts_with({_path("url")}, root_path)""",
        "reachable_pages": _reachable(8),
        "crawl_site": f"""
          SELECT w.*, CASE WHEN url IN ({_THIN}) THEN 'short' END AS drop_reason FROM (
            {_reachable(12, f"SELECT * FROM ({_NATION_LINKS}) WHERE src NOT IN ({_THIN}) AND dst IN (SELECT src FROM ({_NATION_LINKS}))",
                        _NATION_ROOTS, 1000)}) w""",
        "reachable_all": """
          WITH orders_of AS (SELECT DISTINCT o_custkey AS c, o_orderkey AS o FROM orders)
          SELECT c_custkey::VARCHAR AS source_id, 'https://shop.example.com/customers/' || c_custkey AS url, 0 AS depth FROM customer
          UNION ALL SELECT c::VARCHAR, 'https://shop.example.com/orders/' || o, 1 FROM orders_of
          UNION ALL SELECT DISTINCT c::VARCHAR, 'https://shop.example.com/parts/' || l_partkey, 2
          FROM orders_of JOIN lineitem ON l_orderkey = o""",
        "cut_sources": f"""
          WITH walked AS MATERIALIZED ({_reachable(8)}),
          next AS (
            SELECT source_id, 'https://shop.example.com/parts/' || l_partkey AS url
            FROM walked JOIN lineitem ON url = 'https://shop.example.com/orders/' || l_orderkey
            UNION SELECT source_id, 'https://shop.example.com/orders/' || l_orderkey
            FROM walked JOIN lineitem ON url = 'https://shop.example.com/parts/' || l_partkey
            UNION SELECT source_id, 'https://shop.example.com/orders/' || o_orderkey
            FROM walked JOIN orders ON url = 'https://shop.example.com/customers/' || o_custkey),
          more AS (SELECT DISTINCT source_id FROM next WHERE (source_id, url) NOT IN (SELECT (source_id, url) FROM walked))
          SELECT source_id, count(*) AS n_pages, count(*) >= 100 AND source_id IN (SELECT source_id FROM more) AS cut
          FROM walked GROUP BY source_id""",
        "intake_sources": f"""
          WITH requests AS ({_REQUESTS}),
          judged AS (
            SELECT r.*, w.id IS NOT NULL AND regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^\\s/?#]+') AS valid
            FROM requests r LEFT JOIN ({_WORKSPACES}) w ON r.workspace_id = w.id AND r.user_id = w.user_id),
          turns AS (
            SELECT *, row_number() OVER (PARTITION BY url, workspace_id, valid ORDER BY created_at, id) AS turn
            FROM judged)
          SELECT id, url, workspace_id, CASE
              WHEN NOT valid THEN 'rejected'
              WHEN turn = 1 AND (url, workspace_id) NOT IN (
                SELECT (url, workspace_id) FROM ({_SOURCES}) WHERE status = 'DONE') THEN 'accepted'
              ELSE 'conflict' END AS outcome
          FROM turns""",
        "merge_chunks": f"""
          WITH turns AS (
            SELECT concat_ws('-', conv_id, turn) AS id, upper(role) AS role, text FROM conversations)
          SELECT id, source_id, page_url, CASE WHEN labelled THEN page_title || ' v2' ELSE page_title END AS page_title,
            md5(CASE WHEN labelled THEN 'v2 ' || child_text ELSE child_text END) AS child_text
          FROM (SELECT *, id IN (SELECT doc_id::VARCHAR FROM labels) AS labelled FROM ({_CHUNKS}))
          UNION ALL
          SELECT 'turn-' || id, 'chat-1', 'chat://' || id || '/1', role || ' 2', md5('v2 ' || text) FROM turns""",
        "merge_vectors": f"SELECT * REPLACE ({_DIGITS} AS embedding) FROM ({_MERGED_VECTORS})",
        "store_vectors": f"SELECT * REPLACE ({_DIGITS} AS embedding) FROM ({_MERGED_VECTORS})",
        "store_chunks": f"""
          WITH turns AS (SELECT concat_ws('-', conv_id, turn) AS id, upper(role) AS role, text FROM conversations)
          SELECT id, workspace_id, source_id, page_url, CASE WHEN labelled THEN page_title || ' v2' ELSE page_title END AS page_title,
            CASE WHEN labelled THEN 'part 1' ELSE section_heading END AS section_heading,
            md5(CASE WHEN labelled THEN 'v2 ' || child_text ELSE child_text END) AS child_text,
            md5(CASE WHEN labelled THEN upper(page_title || ' v2') ELSE substr(child_text, 1, 40) END) AS parent_text
          FROM (SELECT *, id IN (SELECT doc_id::VARCHAR FROM labels) AS labelled FROM ({_CHUNKS}))
          UNION ALL
          SELECT 'turn-' || id, 'chat-' || substr(id, 1, 1), 'chat-1', 'chat://' || id || '/1', role || ' 2', 'part 2',
            md5('v2 ' || text), md5(role || ' 2') FROM turns""",
        "drop_workspaces": f"""
          SELECT id, workspace_id, source_id FROM ({_CHUNKS}) WHERE workspace_id NOT IN (
            SELECT lang FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING avg(toxic) > 0.125)""",
        "delete_sources": f"""
          SELECT * FROM ({_SOURCES}) WHERE id NOT IN (
            SELECT r.id FROM ({_REQUESTS}) r JOIN ({_WORKSPACES}) w ON r.workspace_id = w.id AND r.user_id = w.user_id)""",
        "embed_texts": f"""
          WITH {_embedding("vectors", f"SELECT id, child_text AS text FROM ({_CHUNKS})", f"SELECT id, child_text AS text FROM ({_CHUNKS})", 768)}
          SELECT id, len(embedding)::BIGINT AS width, {_DIGITS} AS embedding FROM vectors""",
        "answer_pages": _answers(),
        "split_pages": f"""
          SELECT page_id, url, CASE WHEN NOT failed THEN md5(content) END AS content, CASE WHEN failed THEN 'failed' ELSE 'good' END AS output
          FROM ({_extracted(_PAGES_BY_HOST.replace("AS source_id, url", "AS source_id, page_id, url"))})""",
        "delete_by_source": f"""
          SELECT id, workspace_id, source_id FROM ({_CHUNKS}) c WHERE NOT EXISTS (
            SELECT 1 FROM documents d JOIN labels l ON d.doc_id = l.doc_id AND l.toxic = 1
            WHERE d.lang = c.workspace_id AND d.source = c.source_id)""",
        "delete_by_workspace": f"""
          SELECT id, workspace_id, source_id FROM ({_CHUNKS}) WHERE workspace_id NOT IN (
            SELECT lang FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING avg(toxic) > 0.125)""",
        "cascade_delete": f"""
          WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0),
          kept AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone))
          SELECT 'workspace' AS kind, c_custkey::VARCHAR AS id FROM customer
          WHERE c_custkey NOT IN (SELECT c_custkey FROM gone)
          UNION ALL SELECT 'source', o_orderkey::VARCHAR FROM kept
          UNION ALL SELECT 'message', concat_ws('-', l_orderkey, l_linenumber) FROM lineitem
            JOIN kept ON l_orderkey = o_orderkey
          UNION ALL SELECT 'orphan_chunk', concat_ws('-', l_orderkey, l_linenumber) FROM lineitem
            WHERE l_orderkey NOT IN (SELECT o_orderkey FROM kept)""",
        "validate_rows": f"""
          SELECT 'message' AS kind, concat_ws('-', conv_id, turn) AS id,
            CASE WHEN upper(role) IN ('USER', 'ASSISTANT') THEN '' ELSE 'role' END AS errors FROM conversations
          UNION ALL
          SELECT 'workspace', id, CASE WHEN length(name) * 3 > 50 THEN 'name' ELSE '' END FROM ({_WORKSPACES})
          UNION ALL
          SELECT 'page', page_id::VARCHAR, CASE WHEN starts_with(url, 'http:') THEN 'url' ELSE '' END FROM pages
          UNION ALL
          SELECT 'event', event_id::VARCHAR, CASE WHEN event_type = 'error' THEN '' ELSE 'status' END FROM events""",
        "reset_for_reindex": f"""
          WITH owned AS (
            SELECT r.id FROM ({_REQUESTS}) r
            JOIN ({_WORKSPACES}) w ON r.workspace_id = w.id AND r.user_id = w.user_id)
          SELECT id, url, workspace_id, CASE WHEN reset THEN 'PENDING' ELSE status END AS status,
            CASE WHEN NOT reset THEN page_count END AS page_count,
            CASE WHEN NOT reset THEN chunk_count END AS chunk_count,
            CASE WHEN NOT reset THEN error END AS error, created_at
          FROM (SELECT *, id IN (SELECT id FROM owned) AS reset FROM ({_SOURCES}))""",
        "apply_patches": f"""
          WITH patches AS (
            SELECT l_orderkey::VARCHAR AS id, {_PATCH_ORDER} AS seq, l_returnflag AS flag,
              CASE WHEN l_returnflag <> 'N' THEN
                ['PENDING', 'SCRAPING', 'CHUNKING', 'EMBEDDING', 'DONE', 'FAILED'][l_linenumber % 6 + 1] END AS status,
              CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::INTEGER END AS page_count,
              CASE WHEN l_returnflag = 'A' THEN 'line ' || l_linenumber END AS error
            FROM lineitem),
          last AS (
            SELECT id, arg_max(status, seq) FILTER (status IS NOT NULL) AS status,
              arg_max(page_count, seq) FILTER (page_count IS NOT NULL) AS page_count,
              max(seq) FILTER (error IS NOT NULL OR flag = 'R') AS error_seq
            FROM patches GROUP BY 1)
          SELECT s.id, coalesce(l.status, s.status) AS status, coalesce(l.page_count, s.page_count) AS page_count,
            s.chunk_count, CASE WHEN error_seq IS NULL THEN s.error ELSE p.error END AS error
          FROM ({_SOURCES}) s LEFT JOIN last l USING (id)
          LEFT JOIN patches p ON p.id = s.id AND p.seq = error_seq""",
        "patch_workspaces": f"""
          WITH good AS (SELECT * FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')),
          names AS (SELECT o_custkey, 'order ' || max(o_orderkey) AS name FROM good WHERE o_orderpriority <> '2-HIGH' GROUP BY 1),
          texts AS (
            SELECT o_custkey, arg_max({{'text': CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END}}, o_orderkey).text AS description
            FROM good WHERE o_orderstatus IN ('O', 'P') GROUP BY 1),
          bad AS (
            SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS n_workspace, count(*) FILTER (o_orderpriority = '5-LOW') AS n_name
            FROM orders GROUP BY 1)
          SELECT w.id, coalesce(n.name, w.name) AS name, CASE WHEN t.o_custkey IS NULL THEN w.description ELSE t.description END AS description,
            coalesce(n_workspace, 0) AS n_workspace, coalesce(n_name, 0) AS n_name
          FROM ({_WORKSPACES}) w LEFT JOIN names n ON n.o_custkey::VARCHAR = w.id
          LEFT JOIN texts t ON t.o_custkey::VARCHAR = w.id LEFT JOIN bad b ON b.o_custkey::VARCHAR = w.id""",
        "reindex_source": f"""
          WITH fresh AS MATERIALIZED ({_hierarchy(_file_pages())}),
          {_embedding("made", "SELECT id, child_text AS text FROM fresh", "SELECT id, child_text AS text FROM fresh", 64)}
          SELECT id, workspace_id, source_id, md5(child_text) AS child_text, {_DIGITS} AS embedding FROM fresh JOIN made USING (id)""",
        "reindex_changed": f"""
          WITH fresh AS MATERIALIZED ({_hierarchy(_file_pages())}),
          former AS MATERIALIZED ({_hierarchy(_file_pages(f"({_EARLIER_PAGES})"))}),
          {_embedding("made", "SELECT id, child_text AS text FROM fresh", "SELECT id, child_text AS text FROM former", 64)}
          SELECT {hierarchy_columns}, {_DIGITS} AS embedding FROM fresh JOIN made USING (id)""",
        "reindex_work": f"""
          WITH earlier AS MATERIALIZED ({_EARLIER_PAGES}),
          fresh AS MATERIALIZED ({_hierarchy(_file_pages())}),
          former AS MATERIALIZED ({_hierarchy(_file_pages("earlier"))}),
          changed AS (SELECT url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM earlier e WHERE e.url = p.url AND e.html = p.html)),
          stale AS (SELECT url FROM earlier e WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE e.url = p.url AND e.html = p.html)),
          known AS (SELECT DISTINCT workspace_id, child_text FROM former WHERE page_url IN (SELECT url FROM stale)),
          cut AS (
            SELECT source_id, count(*) AS n_cut, count(k.child_text) AS n_reused, count(*) - count(k.child_text) AS n_embedded
            FROM fresh f LEFT JOIN known k ON k.workspace_id = f.workspace_id AND k.child_text = f.child_text
            WHERE page_url IN (SELECT url FROM changed) GROUP BY 1),
          counted AS (
            SELECT 'src-' || {_domain("url")} AS source_id, count(*) AS n_pages, count(*) FILTER (url IN (SELECT url FROM changed)) AS n_changed
            FROM pages GROUP BY 1),
          lost AS (
            SELECT 'src-' || {_domain("url")} AS source_id, count(*) AS n_gone FROM earlier
            WHERE url NOT IN (SELECT url FROM pages) GROUP BY 1)
          SELECT source_id, regexp_extract(source_id, '([^.]+)$', 1) AS workspace_id, n_pages, n_changed, coalesce(n_gone, 0) AS n_gone,
            coalesce(n_cut, 0) AS n_cut, coalesce(n_reused, 0) AS n_reused, coalesce(n_embedded, 0) AS n_embedded
          FROM counted LEFT JOIN lost USING (source_id) LEFT JOIN cut USING (source_id)""",
        "extract_content": f"""
          SELECT page_id, url, title, md5(content) AS content, failed
          FROM ({_extracted("SELECT page_id, url, html FROM pages")})""",
        "clean_text": f"SELECT doc_id, md5({_clean(dirty)}) AS text_md5 FROM documents",
        "quality_gate": f"SELECT doc_id, {_DROP_REASON} AS drop_reason FROM ({_GRADED})",
        "owned_by": f"""
          SELECT s.id, s.workspace_id, (s.id::BIGINT % 25)::VARCHAR AS user_id
          FROM ({_SOURCES}) s JOIN customer ON c_custkey::VARCHAR = s.workspace_id
          WHERE c_nationkey = s.id::BIGINT % 25""",
        "section_label": """
          SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN source ELSE lang || ' notes' END AS section_heading
          FROM documents""",
        "split_failures": f"""
          SELECT source_id, count(*) AS n_pages, count(*) FILTER (failed) AS n_failed,
            CASE WHEN bool_and(failed) THEN 'FAILED' ELSE 'DONE' END AS status,
            CASE WHEN bool_and(failed) THEN 'all pages failed: ' || count(*) END AS error
          FROM ({_extracted(_PAGES_BY_HOST)}) GROUP BY 1""",
        "split_sections": f"""
          SELECT doc_id, section_index::INTEGER AS section_index, heading, md5(text) AS text FROM ({_sections(
            '''SELECT doc_id, replace(text, chr(10), chr(10) || CASE lang WHEN 'en' THEN '## ' WHEN 'fr' THEN '# '
                 WHEN 'de' THEN '###' || chr(9) || ' ' ELSE '#### ' END) AS content FROM documents''', "doc_id")})""",
        "recursive_split_words": _kept_words(_PAGES_AS_DOCUMENTS),
        "chunk_hierarchy_recursive_words": _kept_words(f"SELECT * FROM ({_PAGES_AS_DOCUMENTS}) WHERE length(content) >= 50"),
        "window_split": f"""
          SELECT doc_id, chunk_index::INTEGER AS chunk_index, md5(chunk) AS chunk FROM (
            SELECT doc_id, unnest(chunks) AS chunk, unnest(range(len(chunks))) AS chunk_index
            FROM (SELECT doc_id, {_windows("text", 300, 30)} AS chunks FROM documents))""",
        "chunk_hierarchy": f"""
          SELECT {hierarchy_columns}, length(parent_text) AS parent_length FROM ({_hierarchy(_PAGES_AS_DOCUMENTS)})""",
        "chunk_ids": """
          SELECT doc_id, md5(concat_ws('-', source, url, 2, 'parent', 1)) AS parent_id_section,
            md5(concat_ws('-', source, url, 2, 1, 3, text)) AS id_section,
            md5(concat_ws('-', source, url, 'parent', 1)) AS parent_id_reference,
            md5(concat_ws('-', source, url, 1, 3, text)) AS id_reference
          FROM (SELECT *, 'doc://' || doc_id AS url FROM documents)""",
        "chunk_counts": f"""
          WITH graded AS (SELECT *, {_DROP_REASON} AS drop_reason FROM ({_GRADED}))
          SELECT source_id, coalesce(pages_indexed, 0) AS pages_indexed, coalesce(pages_visited, 0) AS pages_visited,
            coalesce(chunk_count, 0) AS chunk_count
          FROM (SELECT 'src' || n_nationkey AS source_id FROM nation)
          LEFT JOIN (SELECT source_id, count(*) FILTER (drop_reason IS NULL) AS pages_indexed,
                       count(DISTINCT page_url) AS pages_visited FROM graded GROUP BY 1) USING (source_id)
          LEFT JOIN (SELECT source_id, count(*) AS chunk_count
                     FROM ({_hierarchy("SELECT * FROM graded WHERE drop_reason IS NULL")}) GROUP BY 1)
            USING (source_id)""",
        "attach_vectors": """
          SELECT doc_id::VARCHAR AS id, lang AS workspace_id, coalesce(len(embedding), 0)::BIGINT AS width
          FROM documents LEFT JOIN embeddings ON doc_id = vec_id""",
        "keyword_search": f"WITH {_QUESTIONS}, {_CTES_KEYWORD} SELECT * FROM keyword",
        "keyword_search_postings": f"WITH {_QUESTIONS}, {_CTES_KEYWORD} SELECT * FROM keyword",
        "vector_search": f"WITH {_QUESTIONS}, {_CTES_VECTOR} SELECT * FROM vector",
        "vector_search_approximate": f"WITH {_QUESTIONS}, {_CTES_VECTOR} SELECT * FROM vector",
        "vector_index_quality": f"""
          WITH {_QUESTIONS}, {_CTES_VECTOR}
          SELECT (SELECT count(*) FROM vector) AS n_true, (SELECT count(*) FROM vector) AS n_found,
            (SELECT count(*) FROM scored) AS n_products, true AS fifth_or_less""",
        "tenant_filter": f"""
          SELECT id, workspace_id FROM ({_SOURCES})
          WHERE workspace_id IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_acctbal < 0)""",
        "overfetch": f"""
          WITH {_QUESTIONS}, {_CTES_KEYWORD}, {_CTES_VECTOR}
          SELECT *, 'vector' AS list FROM vector UNION ALL SELECT *, 'keyword' FROM keyword""",
        "rrf_fuse": f"{_WITH_FUSED} SELECT * FROM fused",
        "confidence": f"""
          {_WITH_FUSED}
          SELECT question_id, count(f.id) AS n_hits, max(f.score) AS top_score,
            coalesce(max(f.score) >= 0.02, false) AS confident,
            CASE WHEN max(f.score) IS NULL THEN 'none' WHEN max(f.score) < 0.02 THEN 'low' END AS reason
          FROM questions LEFT JOIN fused f USING (question_id) GROUP BY 1""",
        "hybrid_search": f"""
          {_WITH_FUSED}
          SELECT fused.*, page_url, page_title, section_heading, md5(child_text) AS child_text
          FROM fused JOIN ({_CHUNKS}) USING (id)""",
        "parent_context": f"""
          {_WITH_FUSED}
          SELECT question_id, parent_id, min(rank) AS rank, max(score) AS score, count(*) AS n_children,
            min(source_id) AS parent_text
          FROM fused JOIN ({_CHUNKS}) USING (id) GROUP BY 1, 2""",
        "workspace_list": f"""
          SELECT w.*, s.id AS source_id, s.status AS source_status
          FROM ({_WORKSPACES}) w LEFT JOIN ({_SOURCES}) s ON s.workspace_id = w.id""",
        "workspace_messages": f"""
          SELECT w.id, w.user_id, coalesce(n, 0) AS message_count
          FROM ({_WORKSPACES}) w
          LEFT JOIN (SELECT workspace_id, count(*) AS n FROM ({_MESSAGES}) GROUP BY 1) m ON m.workspace_id = w.id""",
        "workspace_detail": f"""
          SELECT w.*, s.id AS source_id, s.url AS source_url, s.status AS source_status, s.page_count AS source_page_count,
            s.chunk_count AS source_chunk_count, s.error AS source_error, s.created_at AS source_created_at
          FROM ({_WORKSPACES}) w LEFT JOIN ({_SOURCES}) s ON s.workspace_id = w.id
          WHERE user_id = (w.id::BIGINT % 25)::VARCHAR""",
        "source_list": f"""
          SELECT s.* FROM ({_SOURCES}) s JOIN ({_WORKSPACES}) w ON s.workspace_id = w.id
          WHERE user_id = (w.id::BIGINT % 25)::VARCHAR""",
        "stream_ingest": f"SELECT {hierarchy_columns} FROM ({_hierarchy(_file_pages())})",
        "stream_ingest_status": f"""
          SELECT source_id, count(*) AS n_pages, count(*) FILTER (failed) AS n_failed,
            CASE WHEN bool_and(failed) THEN 'FAILED' ELSE 'DONE' END AS status,
            CASE WHEN bool_and(failed) THEN 'all pages failed: ' || count(*) END AS error,
            count(*) AS n_scraped, true AS all_ended
          FROM ({_extracted(f"SELECT 'src-' || {_domain('url')} AS source_id, url, html FROM pages")}) GROUP BY 1""",
        "stream_vectors": f"""
          WITH fresh AS MATERIALIZED ({_hierarchy(_file_pages())}),
          {_embedding("made", "SELECT id, child_text AS text FROM fresh", "SELECT id, child_text AS text FROM fresh", 64)}
          SELECT id AS chunk_id, workspace_id, source_id, {_DIGITS} AS embedding FROM fresh JOIN made USING (id)""",
        "stream_stages": """
          WITH pages AS (
            SELECT user_id::VARCHAR AS source_id, epoch_us(ts) // 1000 AS tick, event_type IN ('error', 'signup') AS bad,
              CASE WHEN event_type IN ('click', 'purchase') THEN floor(abs(value))::BIGINT + 1 ELSE 0 END AS n FROM events),
          marked AS (
            SELECT *, coalesce(tick > lag(tick) OVER turn + 21600000, true) AS begins FROM pages WINDOW turn AS (PARTITION BY source_id ORDER BY tick, n)),
          runs AS (SELECT *, sum(begins::INT) OVER (PARTITION BY source_id ORDER BY tick, n) AS number FROM marked),
          steps AS (
            SELECT *, min(tick) OVER (PARTITION BY source_id, number) AS run, count(*) OVER turn AS pages, sum(n) OVER turn AS chunks,
              count(*) FILTER (NOT bad) OVER turn AS goods, count(*) FILTER (n > 0) OVER turn AS filled
            FROM runs WINDOW turn AS (PARTITION BY source_id, number ORDER BY tick, n ROWS UNBOUNDED PRECEDING)),
          ends AS (
            SELECT source_id, number, run, max(tick) + 21600000 AS tick, count(*) AS pages, sum(n) AS chunks, bool_and(bad) AS failed,
              number < max(number) OVER (PARTITION BY source_id) AS followed
            FROM steps GROUP BY source_id, number, run),
          events_of AS (
            SELECT source_id, run, 0 AS step, 'SCRAPING' AS status, 0 AS pages, 0 AS chunks, NULL AS error, tick FROM steps WHERE begins
            UNION ALL SELECT source_id, run, 1, 'CHUNKING', pages, chunks, NULL, tick FROM steps WHERE NOT bad AND goods = 1
            UNION ALL SELECT source_id, run, 2, 'EMBEDDING', pages, chunks, NULL, tick FROM steps WHERE n > 0 AND filled = 1
            UNION ALL SELECT source_id, run, 3, CASE WHEN failed THEN 'FAILED' ELSE 'DONE' END, pages, chunks,
              CASE WHEN failed THEN 'all pages failed: ' || pages END, tick
            FROM ends WHERE followed OR tick < (SELECT max(tick) - 3600000 FROM pages))
          SELECT source_id, run::BIGINT AS run, step::INTEGER AS step, status, pages::BIGINT AS pages, chunks::BIGINT AS chunks, error, make_timestamp_ms(tick::BIGINT) AS ts
          FROM events_of""",
        "stream_dedup_requests": f"SELECT DISTINCT source_id FROM ({_STATUS_EVENTS}) WHERE status = 'PENDING'",
        "stream_request_runs": f"""
          WITH requests AS (SELECT source_id, ts FROM ({_STATUS_EVENTS}) WHERE status = 'PENDING'),
          marked AS (
            SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY source_id ORDER BY ts) + INTERVAL 2 DAY, true) AS begins FROM requests),
          runs AS (SELECT *, sum(begins::INT) OVER (PARTITION BY source_id ORDER BY ts) AS run FROM marked)
          SELECT source_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_requests FROM runs GROUP BY source_id, run
          HAVING max(ts) + INTERVAL 2 DAY <= (SELECT max(ts) FROM requests) - INTERVAL 1 HOUR""",
        "stream_status_latest": f"""
          SELECT source_id, status, ts FROM ({_STATUS_EVENTS})
          QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, event_id DESC) = 1""",
        "stream_status_route": f"""
          SELECT workspace_id, n_name AS user_id, source_id, status, event_id::INTEGER AS page_count,
            NULL::INTEGER AS chunk_count, NULL::VARCHAR AS error
          FROM ({_STATUS_EVENTS}) JOIN nation ON n_regionkey::VARCHAR = workspace_id
          WHERE status <> 'FAILED' AND NOT (status = 'DONE' AND event_id % 2 = 0)""",
        "stream_page_progress": f"""
          SELECT source_id, count(*) AS page_count FROM ({_extracted(_PAGES_BY_HOST)})
          WHERE NOT failed AND length(content) > 100 GROUP BY 1""",
    }
