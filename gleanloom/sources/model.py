"""The declared tables and their allowed values."""

from __future__ import annotations

# Allowed states of a source and roles of a message.
SOURCE_STATUS = ["PENDING", "SCRAPING", "CHUNKING", "EMBEDDING", "DONE", "FAILED"]
MESSAGE_ROLE = ["USER", "ASSISTANT"]

WORKSPACES = (
    "id STRING, name STRING, description STRING, user_id STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)
SOURCES = (
    "id STRING, url STRING, workspace_id STRING, status STRING, page_count INT, chunk_count INT, "
    "error STRING, created_at TIMESTAMP"
)
MESSAGES = (
    "id STRING, workspace_id STRING, role STRING, content STRING, sources STRING, created_at TIMESTAMP"
)
PAGES = "page_id BIGINT, url STRING, html STRING"
CHUNKS = (
    "id STRING, parent_id STRING, source_id STRING, workspace_id STRING, page_url STRING, page_title STRING, "
    "section_index INT, section_heading STRING, parent_index INT, chunk_index INT, parent_text STRING, "
    "child_text STRING, created_at TIMESTAMP"
)
VECTORS = "chunk_id STRING, workspace_id STRING, source_id STRING, embedding ARRAY<FLOAT>"
# Field names of a published status message; the public five exclude the workspace.
STATUS_MESSAGE = (
    "workspaceId STRING, sourceId STRING, status STRING, pageCount INT, chunkCount INT, error STRING, ts TIMESTAMP"
)
STATUS_CHANNEL = "source:status"
