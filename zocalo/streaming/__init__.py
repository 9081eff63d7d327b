"""Structured Streaming versions of the online jobs."""

from zocalo.streaming.jobs import (file_stream, log_usage, merge_into_log, merged_log, redacted, run_to_end,  # noqa: F401
                                   structured, usage_counts)
