"""Readers of published files as tables of text, and of snapshots as typed tables.

Every reader leaves the parsing to Spark's own sources and to columns; `ord` numbers a file's rows in
their order, for rules by which the first or the last row wins.
"""
