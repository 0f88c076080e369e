"""Structured Streaming over job log lines."""

from shelfspark.streaming.jobs import (  # noqa: F401
    drain,
    late_lines,
    parts_with_late,
    state_rows,
    fold_blocks,
    fold_status,
    job_status_stream,
    purge_archived_stream,
    session_blocks_stream,
)
