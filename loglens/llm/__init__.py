"""Training-data operators: token counts, quality and toxicity scores, chat formatting, WARC archives,
packing, mixing, exact / n-gram / embedding near-duplicates.

Nothing else in the library imports this subpackage.
"""
