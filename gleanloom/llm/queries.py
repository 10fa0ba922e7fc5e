"""The registered query of each operator, over its whole table, and the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanloom.llm import alignment, audio, chat, decontaminate, exact, minhash, mixing, pii, quality, records, sharding, toxicity, trie
from gleanloom.llm.common import held_out, sql_hash60, written
from gleanloom.sources.tables import read_table


def op1_boosted_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(read_table(spark, folder, "documents"))


def op2_audio_features(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    stored = written(audio.store_media(docs), "media", compression="zstd")
    return audio.digests(stored)


def op3_weighted_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.duplicate_classes(read_table(spark, folder, "documents").select("doc_id", "text"))


def op4_spaced_seeds(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, read_table(spark, folder, "benchmark"))


def op5_framed_tokens(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path, index_path = records.scratch(spark)
    docs = read_table(spark, folder, "documents")
    records.write_records(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    index = records.with_starts(records.write_index(spark, path, index_path))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")


def op6_lookup_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id")
    return sharding.assign_shards(docs, F.col("doc_id"))


def op7_folded_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, read_table(spark, folder, "labels"))


def op8_transcript_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Turns are written out as plain transcripts; the roles are then found without looking at the role column."""
    turns = chat.as_transcript(read_table(spark, folder, "conversations"))
    model = chat.fit(turns.where(~held_out(F.col("id"))), "id", "place", "role", "text")
    rows = chat.parsed(turns.select("id", "place", "text"), model)
    return rows.select(F.col("id").alias("conv_id"), "place", "piece", "number", "begins", "role", "n_lines",
                       F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"))


def op9_curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Range-sorted by the first training position; documents that are not placed come last."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "position")
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op10_latent_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return quality.quality(docs, read_table(spark, folder, "labels"))


def op11_salted_exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(read_table(spark, folder, "documents").select("doc_id", "text"))


def op12_bitmap_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(read_table(spark, folder, "conversations"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_boosted_pii": op1_boosted_pii,
    "op2_audio_features": op2_audio_features,
    "op3_weighted_minhash": op3_weighted_minhash,
    "op4_spaced_seeds": op4_spaced_seeds,
    "op5_framed_tokens": op5_framed_tokens,
    "op6_lookup_sharding": op6_lookup_sharding,
    "op7_folded_lexicon": op7_folded_lexicon,
    "op8_transcript_roles": op8_transcript_roles,
    "op9_curriculum_mix": op9_curriculum_mix,
    "op10_latent_neighbours": op10_latent_neighbours,
    "op11_salted_exact": op11_salted_exact,
    "op12_bitmap_trie": op12_bitmap_trie,
    "op13_token_alignment": op13_token_alignment,
}


def sharding_sql() -> str:
    """The table is filled by the operator's rule; hash, slot and lookup are SQL's own."""
    table = ", ".join(map(str, sharding.fill_table(sharding.shard_names())))
    return f"""
        WITH slots AS (SELECT unnest(range({sharding.TABLE_SIZE})) AS slot, unnest([{table}])::INTEGER AS shard)
        SELECT doc_id, slot, shard
        FROM (SELECT doc_id, {sql_hash60("doc_id")} % {sharding.TABLE_SIZE} AS slot FROM documents) JOIN slots USING (slot)"""


def mixing_sql() -> str:
    cases = []
    for k, knots in enumerate(mixing.SCHEDULES):
        pieces = []
        for t0, length, w0, slope, done, area in mixing.segments(knots):
            rest = f"(fraction - {done!r}::DOUBLE)"
            if abs(slope) < 1e-12:
                time = f"{t0!r}::DOUBLE + {rest} / {w0!r}::DOUBLE"
            else:
                time = (f"{t0!r}::DOUBLE + (sqrt(greatest(0::DOUBLE, {w0 * w0!r}::DOUBLE + {2 * slope!r}::DOUBLE * {rest}))"
                        f" - {w0!r}::DOUBLE) / {slope!r}::DOUBLE")
            pieces.append((done + area, time))
        inner = " ".join(f"WHEN fraction < {end!r}::DOUBLE THEN {time}" for end, time in pieces[:-1])
        last = pieces[-1][1]
        cases.append(f"WHEN turn % {len(mixing.SCHEDULES)} = {k} THEN {f'CASE {inner} ELSE {last} END' if inner else last}")
    weights = " ".join(f"WHEN {k} THEN {w!r}::DOUBLE" for k, w in enumerate(mixing.WEIGHTS))
    return f"""
        WITH RECURSIVE sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                   {sql_hash60("doc_id")} AS ord
            FROM documents),
        totals AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn
            FROM sized GROUP BY source),
        weighed AS (
            SELECT *, CASE turn % {len(mixing.WEIGHTS)} {weights} END AS weight, source_size * {mixing.CAP!r}::DOUBLE AS cap
            FROM totals),
        rounds AS (
            SELECT 0 AS step, source, source_size, turn, weight, cap, false AS closed,
                   (SELECT sum(source_size) FROM totals) * {mixing.SHARE!r}::DOUBLE * weight / (SELECT sum(weight) FROM weighed) AS level
            FROM weighed
            UNION ALL
            SELECT step + 1, source, source_size, turn, weight, cap, closed OR level > cap,
                   CASE WHEN closed OR level > cap THEN cap ELSE weight
                     * ((SELECT sum(source_size) FROM totals) * {mixing.SHARE!r}::DOUBLE
                        - coalesce(sum(cap) FILTER (closed OR level > cap) OVER (), 0))
                     / nullif(sum(weight) FILTER (NOT (closed OR level > cap)) OVER (), 0) END
            FROM rounds WHERE step < (SELECT count(*) FROM totals)),
        targets AS (
            SELECT source, source_size, turn, level AS target FROM rounds
            WHERE step = (SELECT count(*) FROM totals)),
        placed AS (
            SELECT doc_id, size, source_size, turn, target, floor(target + 1e-6)::BIGINT AS words,
                   sum(size) OVER (PARTITION BY s.source ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
        parts AS (
            SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS passes FROM placed),
        taken AS (
            SELECT *, greatest(0, least(size, words - passes * source_size - start)) AS part, start / target AS fraction FROM parts)
        SELECT doc_id, size, source_size, target, (passes * size + part)::BIGINT AS taken,
               (CASE WHEN size = 0 THEN 0 ELSE passes + (part > 0)::BIGINT END)::BIGINT AS copies,
               CASE WHEN size > 0 AND passes + (part > 0)::BIGINT > 0 THEN round(CASE {" ".join(cases)} END, 9) END AS position
        FROM taken"""


EXACT_SQL = """
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS whole FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY whole) AS keep_id, count(*) OVER (PARTITION BY whole) AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY whole)
             AND row_number() OVER (PARTITION BY whole, doc_id) = 1 AS kept,
           sha256(whole) AS text_sha256
    FROM texts"""

#: The CRC-32 is written out: DuckDB has none.
TRIE_SQL = """
    WITH turns AS (
        SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
        FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (
        SELECT c, count(*) AS n, c - c % 20 AS base,
               xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
                   lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                       lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 4 AS h
        FROM turns GROUP BY c),
    sized AS (SELECT v.*, least(v.h, coalesce(b.n, 0)) AS k FROM convs v LEFT JOIN convs b ON b.c = v.base),
    rebuilt AS (
        SELECT c, pos - h + k AS pos, role, text FROM turns JOIN sized USING (c) WHERE pos >= h
        UNION ALL
        SELECT s.c, t.pos, t.role, t.text FROM sized s JOIN turns t ON t.c = s.base AND t.pos < s.k),
    prefixes AS (
        SELECT c, pos + 1 AS depth, list(md5(length(role) || ':' || role || text)) OVER (PARTITION BY c ORDER BY pos) AS path,
               len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
        FROM rebuilt
        UNION ALL SELECT c, 0, [], 0 FROM sized),
    named AS (SELECT c, depth, words, md5(array_to_string(path, ',')) AS node, md5(array_to_string(path[:-2], ',')) AS parent FROM prefixes),
    last AS (SELECT c, max(depth) AS depth FROM named GROUP BY c),
    nodes AS (
        SELECT node, depth, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
               list(c ORDER BY c) FILTER (c IN (SELECT last.c FROM last WHERE last.c = named.c AND last.depth = named.depth)) AS ends
        FROM named GROUP BY node, depth),
    children AS (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent, depth),
    below AS (
        SELECT a.node, a.depth, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.words) AS saved_tokens
        FROM nodes b JOIN named a ON a.c = b.conv_id AND a.depth <= b.depth
        LEFT JOIN children k ON k.parent = b.node AND k.depth = b.depth
        GROUP BY a.node, a.depth)
    SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
           s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens,
           sha256(coalesce(array_to_string(n.ends, ','), '')) AS ends_sha256
    FROM nodes n JOIN below s ON s.node = n.node AND s.depth = n.depth
    LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.parent AND p.depth = n.depth - 1
    LEFT JOIN children k ON k.parent = n.node AND k.depth = n.depth"""


def oracles() -> dict[str, str]:
    return {"op6_lookup_sharding": sharding_sql(), "op9_curriculum_mix": mixing_sql(), "op11_salted_exact": EXACT_SQL, "op12_bitmap_trie": TRIE_SQL}
