"""Readers and writers: per-entity CSV folders, time dimensions, window tables, and adapters of the test tables."""
