"""Stored tables: readers, writers, upserts, ledgers; and views over the test tables."""
