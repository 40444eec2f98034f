"""Readers: driver tables, log files, taxonomy JSON, page tables, source trees."""
