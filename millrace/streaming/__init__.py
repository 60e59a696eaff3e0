"""Streams of delimited files.

The batch operators of ``millrace.operators`` that keep no order (selection,
projection, semi and inner joins with static tables, grouping) apply to the
streaming frames of ``stream_table`` as they are.
"""

from millrace.sources.delimited import stream_table

__all__ = ["stream_table"]
