"""Datasets built from published files: joins, groupings and code names over tables of text."""
