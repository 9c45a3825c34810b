"""Structs of the stored tables."""

from __future__ import annotations

#: One file of a listing.  ``hash`` is the source's own version token; ``size`` is -1 where it is unknown.
ENTRY = "path string, size long, mtime timestamp, hash string, metadata map<string,string>"
#: One observed change.
EVENT = f"connector string, kind string, observed timestamp, {ENTRY}"
#: One successful write, append-only; ``id`` ascends.
SYNC_LOG = (
    "id long, ts timestamp, channel_name string, source_connector string, source_path string, source_version string,"
    " dest_id string, kind string, file_size long, file_hash string, source_stem string, source_dir string"
)
#: One item of work.
WORK = (
    "id long, channel_name string, kind string, source_connector string, source_path string, source_version string,"
    " dest_id string, payload string, status string, attempts int, next_run_at timestamp, created_at timestamp, last_error string"
)
#: One outcome of a manifest line.  ``uploaded`` and ``filed`` rows are markers.
LEDGER = "line long, hash string, action string, dest_id string, file string, error string, warn string, token string, filed array<string>"
#: One value for one field of a record; ``value`` is a variant in long tables, text here.
FIELD = "name string, value string, language string"

CREATE, UPDATE, DELETE = "OnCreate", "OnUpdate", "OnDelete"
KINDS = (CREATE, UPDATE, DELETE)
STATUSES = ("pending", "running", "failed")
STAGES = ("uploading", "committed", "created", "unknown")
