"""Operators on key-value data, logs, indexes, snapshots and change feeds."""
