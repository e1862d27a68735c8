"""tagscope: process-tag history analytics expressed as Spark DataFrame jobs.

A history is any DataFrame with the columns ``TagName string``,
``DateTime timestamp_ntz`` and ``Value double``.  Every operator takes such a
DataFrame (plus plain Python parameters) and returns a DataFrame; nothing is
collected to the driver and all tags are processed in one job.
"""

from tagscope.session import build_session, checkpoint_dir  # noqa: F401

__all__ = ["build_session", "checkpoint_dir"]
