"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

FRAMES = "frame_id long, ts_ms long, kind string, track string, uri string, title string, role string, status string, parent_id long, chunk_index int, chunk_count int, supersedes long, superseded_by long, content string, search_text string, metadata map<string,string>, tags array<struct<key:string,value:string>>, labels array<string>, content_dates array<string>, generation long"
EMBEDDINGS = "frame_id long, embedding array<float>"
MUTATIONS = "seq long, op string, frame_id long, other_id long, content string, ts_ms long"
#: Domains of the enumerated columns.
ROLES = ("document", "chunk", "blob", "system")
STATUSES = ("active", "deleted")
OPS = ("put", "delete", "supersede", "embed")

frames_type = T.StructType.fromDDL(FRAMES)
