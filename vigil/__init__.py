"""vigil: a Spark-native engine for monitoring-check results.

Check results are decoded, split into display text and metric samples,
classified, stored as time-partitioned tables, and queried for the latest
status / metric history of every check at once. A check registry is kept
from a change feed, its references are resolved, mutes are folded, schedules
are expanded and alerts are routed to an outbox table. Everything is
DataFrame / SQL / Structured Streaming.
"""

__all__ = ["session", "schemas"]
