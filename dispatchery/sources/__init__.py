"""Readers and writers: tables, feeds, pages and stored snapshots."""
