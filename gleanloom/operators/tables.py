"""Intake, validation and maintenance of the stored tables. All of it is joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanloom.functions.urls import is_valid_url
from gleanloom.scale import broadcast_if_small, cut_lineage, fits_broadcast, in_workspaces
from gleanloom.sources.model import MESSAGE_ROLE, SOURCE_STATUS

# On an upsert of an existing chunk only these change.
MUTABLE_CHUNK_COLUMNS = ["child_text", "parent_text", "page_title", "section_heading"]
# Length limits of a workspace's name and description.
NAME_LENGTH = (1, 50)
DESCRIPTION_LENGTH = (1, 200)


def owned_by(rows: DataFrame, workspaces: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Rows of ``(workspace_id, user_id)`` whose workspace belongs to that user.

    With ``users(user_id)`` given, rows of any workspace that one of these users owns.
    """
    owners = workspaces.select(F.col("id").alias("workspace_id"), "user_id")
    if users is None:
        return rows.join(owners, ["workspace_id", "user_id"], "left_semi").select(*rows.columns)
    mine = owners.join(broadcast_if_small(users.select("user_id").distinct()), "user_id", "left_semi")
    return rows.join(mine.select("workspace_id"), "workspace_id", "left_semi").select(*rows.columns)


def tenant_filter(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of the asked workspaces only; on a table partitioned by workspace the others are not read while few are asked."""
    return in_workspaces(rows, asked).select(*rows.columns)


def _outside(length: Column, limits: tuple[int, int]) -> Column:
    return (length < limits[0]) | (length > limits[1])


def workspace_errors(name: Column, description: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(name.isNull() | _outside(F.length(name), NAME_LENGTH), "name"),
            F.when(description.isNotNull() & _outside(F.length(description), DESCRIPTION_LENGTH), "description"),
        )
    )


def url_errors(url: Column) -> Column:
    return F.array_compact(F.array(F.when(~is_valid_url(url), "url")))


def role_errors(role: Column) -> Column:
    return F.array_compact(F.array(F.when(role.isNull() | ~role.isin(MESSAGE_ROLE), "role")))


def status_errors(status: Column) -> Column:
    return F.array_compact(F.array(F.when(status.isNull() | ~status.isin(SOURCE_STATUS), "status")))


def validate_rows(rows: DataFrame, errors: Column) -> DataFrame:
    """Adds ``errors array<string>``; rows with none are good, the others go to quarantine."""
    return rows.withColumn("errors", errors)


def split_valid(rows: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    checked = validate_rows(rows, errors)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def intake_sources(
    requests: DataFrame, workspaces: DataFrame, existing: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(accepted, conflicts, rejected)`` of ``requests(id, url, workspace_id, user_id, created_at)``.

    Rejected: not the owner, or no valid URL. Conflict: the pair (url, workspace) exists or an earlier
    request of the batch has it. Accepted rows are new sources with status PENDING.
    """
    # every row is judged by itself: ids may repeat or be missing, and a missing one is made from the request
    made = F.md5(F.to_json(F.struct("url", "workspace_id", "user_id", F.col("created_at").cast("string"))))
    rows = requests.withColumn("id", F.coalesce("id", made)).withColumn("_row", F.monotonically_increasing_id())
    owners = workspaces.select(F.col("id").alias("workspace_id"), "user_id").distinct().withColumn("_own", F.lit(True))
    rows = cut_lineage(rows.join(owners, ["workspace_id", "user_id"], "left").select(*requests.columns, "_row", "_own"))
    own = rows.where("_own").drop("_own")
    foreign = rows.where("_own is null").drop("_own").withColumn("errors", F.array(F.lit("workspace")))
    valid, invalid = split_valid(own, url_errors(F.col("url")))
    # the earliest request of each pair, by an aggregate: a URL asked for a million times is no hot sort
    earliest = (
        valid.groupBy("url", "workspace_id")
        .agg(F.min(F.struct("created_at", "id", "_row")).alias("_first"))
        .join(existing.select("url", "workspace_id"), ["url", "workspace_id"], "left_anti")
        .select(F.col("_first._row").alias("_row"), F.lit(True).alias("_fresh"))
    )
    placed = valid.join(earliest, "_row", "left").withColumn("_fresh", F.coalesce("_fresh", F.lit(False)))
    accepted = placed.where("_fresh").select(
        "id",
        "url",
        "workspace_id",
        F.lit("PENDING").alias("status"),
        F.lit(None).cast("int").alias("page_count"),
        F.lit(None).cast("int").alias("chunk_count"),
        F.lit(None).cast("string").alias("error"),
        "created_at",
    )
    conflicts = placed.where(~F.col("_fresh")).select(*requests.columns)
    return accepted, conflicts, foreign.unionByName(invalid).drop("_row")


def _total(log: DataFrame, version: str) -> Column:
    """Order of a log's rows: by version, then by content, so that equal versions are decided alike on every run."""
    return F.struct(F.col(version), F.md5(F.to_json(F.struct(*[c for c in log.columns if c != version]))))


def latest_chunks(log: DataFrame, version: str = "version") -> DataFrame:
    """Chunk table from a log of upserts: what the first write of an id fixed, what the last one changed.

    Applying upserts one by one gives the same table. An aggregate with map-side combine: a batch that
    repeats one id many times does not collect it.
    """
    fixed = [c for c in log.columns if c not in (*MUTABLE_CHUNK_COLUMNS, "id", version)]
    changing = [c for c in log.columns if c in MUTABLE_CHUNK_COLUMNS]
    order = _total(log, version)
    latest = log.groupBy("id").agg(
        F.min_by(F.struct(*fixed), order).alias("_first"), F.max_by(F.struct(*changing), order).alias("_last")
    )
    return latest.select("id", "_first.*", "_last.*")


def merge_chunks(target: DataFrame, updates: DataFrame, version: str = "version") -> DataFrame:
    """Upsert by id. An existing row changes only in four columns; a new one takes all columns.

    Updates measured to be small are broadcast and the target is not shuffled; otherwise both sides
    meet in one full outer join on the id.
    """
    columns = target.columns
    new = latest_chunks(updates.select(*columns, version), version).select(*columns)
    renamed = new.select("id", *[F.col(c).alias(f"_new_{c}") for c in columns if c != "id"]).withColumn(
        "_updated", F.lit(True)
    )

    def merged(name: str) -> Column:
        if name == "id":
            return F.col("id")
        if name in MUTABLE_CHUNK_COLUMNS:
            return F.when(F.col("_updated"), F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name)
        return F.when(F.col("_stored"), F.col(name)).otherwise(F.col(f"_new_{name}")).alias(name)

    stored = target.withColumn("_stored", F.lit(True))
    if not fits_broadcast(updates):
        return stored.join(renamed, "id", "full_outer").select(*[merged(c) for c in columns])
    kept = stored.join(F.broadcast(renamed), "id", "left").select(*[merged(c) for c in columns])
    known = target.select("id").join(F.broadcast(new.select("id")), "id", "left_semi")
    return kept.unionByName(new.join(known, "id", "left_anti"))


def merge_vectors(target: DataFrame, updates: DataFrame, version: str = "version") -> DataFrame:
    """Upsert by (workspace, chunk): the newest row replaces the old one as a whole."""
    newest = latest_vectors(updates.select(*target.columns, version), version).select(*target.columns)
    keys = ["workspace_id", "chunk_id"]
    replaced = broadcast_if_small(newest.select(*keys), bound=updates.select(*keys))
    return target.join(replaced, keys, "left_anti").select(*target.columns).unionByName(newest)


def latest_vectors(log: DataFrame, version: str = "version") -> DataFrame:
    keys = ["workspace_id", "chunk_id"]
    rest = [c for c in log.columns if c not in (*keys, version)]
    return (
        log.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), _total(log, version)).alias("_last"))
        .select(*keys, "_last.*")
    )


def delete_by_source(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows of chunks or vectors left after dropping sources ``(workspace_id, source_id)``."""
    keys = deleted.select("workspace_id", "source_id").distinct()
    return rows.join(broadcast_if_small(keys), ["workspace_id", "source_id"], "left_anti").select(*rows.columns)


def delete_by_workspace(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    keys = deleted.select("workspace_id").distinct()
    return rows.join(broadcast_if_small(keys), "workspace_id", "left_anti").select(*rows.columns)


def cascade_delete_workspaces(
    requests: DataFrame, workspaces: DataFrame, sources: DataFrame, messages: DataFrame, chunks: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(workspaces, sources, messages, orphan chunks)`` after owners' requests ``(workspace_id, user_id)``.

    Chunks have no foreign key: they stay, and those left without a source are reported.
    """
    gone = owned_by(requests, workspaces).select("workspace_id").distinct()
    left = workspaces.join(gone.withColumnRenamed("workspace_id", "id"), "id", "left_anti")
    left_sources = delete_by_workspace(sources, gone)
    left_messages = delete_by_workspace(messages, gone)
    return left, left_sources, left_messages, orphan_chunks(chunks, left_sources)


def orphan_chunks(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    known = sources.select(F.col("id").alias("source_id"))
    return chunks.join(known, "source_id", "left_anti").select(*chunks.columns)


def _owned_sources(requests: DataFrame, sources: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Ids of the requested sources ``(source_id, user_id)`` that the asking user owns."""
    asked = sources.select(F.col("id").alias("source_id"), "workspace_id").join(
        broadcast_if_small(requests.select("source_id", "user_id").distinct()), "source_id"
    )
    return owned_by(asked, workspaces).select(F.col("source_id").alias("id")).distinct()


def delete_sources(requests: DataFrame, sources: DataFrame, workspaces: DataFrame) -> DataFrame:
    return sources.join(_owned_sources(requests, sources, workspaces), "id", "left_anti")


def reset_for_reindex(requests: DataFrame, sources: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Sources with the owners' requested ones set back to PENDING, their counts and error cleared."""
    owned = _owned_sources(requests, sources, workspaces).withColumn("_reset", F.lit(True))
    joined = sources.join(owned, "id", "left")
    cleared = {
        c: F.when(F.col("_reset"), F.lit(None).cast(sources.schema[c].dataType)).otherwise(F.col(c))
        for c in ("page_count", "chunk_count", "error")
    }
    status = F.when(F.col("_reset"), "PENDING").otherwise(F.col("status"))
    return joined.withColumns({"status": status, **cleared}).select(*sources.columns)


def apply_patches(rows: DataFrame, patches: DataFrame, fields: list[str]) -> DataFrame:
    """Partial updates: per id and field the last patch (by ``seq``) that sets the field wins.

    A patch sets a field by a value, or to NULL by naming it in ``null_fields array<string>``. Patches
    are combined per id before the join; an unknown id changes nothing. Patches of equal ``seq`` are taken by value.
    """
    last = []
    for f in fields:
        sets = F.col(f).isNotNull() | F.coalesce(F.array_contains("null_fields", f), F.lit(False))
        value = F.when(~F.coalesce(F.array_contains("null_fields", f), F.lit(False)), F.col(f))
        last.append(F.max_by(F.struct(value.alias("value")), F.when(sets, F.struct("seq", value.alias("value")))).alias(f"_set_{f}"))
    combined = patches.groupBy("id").agg(*last)
    patched = {
        f: F.when(F.col(f"_set_{f}").isNotNull(), F.col(f"_set_{f}.value")).otherwise(F.col(f)) for f in fields
    }
    return rows.join(combined, "id", "left").withColumns(patched).select(*rows.columns)


def patch_workspaces(patches: DataFrame, workspaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(workspaces, rejected)`` after ``patches(id, user_id, seq, name, description, null_fields)`` by their owners.

    Rejected, with ``errors``: patches of a workspace that the user doesn't own, or that there isn't, a name or
    description outside its limits, and a name set to NULL. The others are applied as by ``apply_patches``, so that a rejected
    patch hides no earlier one.
    """
    owners = workspaces.select("id", "user_id").distinct().withColumn("_own", F.lit(True))
    unnamed = F.coalesce(F.array_contains("null_fields", "name"), F.lit(False))
    errors = F.array_compact(F.array(
        F.when(F.col("_own").isNull(), "workspace"),
        F.when(unnamed | (F.col("name").isNotNull() & _outside(F.length("name"), NAME_LENGTH)), "name"),
        F.when(F.col("description").isNotNull() & _outside(F.length("description"), DESCRIPTION_LENGTH), "description"),
    ))
    placed = patches.join(owners, ["id", "user_id"], "left").select(*patches.columns, errors.alias("errors"))
    accepted, rejected = placed.where(F.size("errors") == 0), placed.where(F.size("errors") > 0)
    return apply_patches(workspaces, accepted, ["name", "description"]), rejected
