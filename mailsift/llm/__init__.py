"""Training-data operators: packing, repeated-passage removal, quality rules,
mixing, chat formatting, quality scores, near-duplicates, nearest neighbours,
language identification and secret scans.

Nothing outside this subpackage imports it; ``queries.py`` registers its
queries, ``corpus_pipeline.py`` at the top of the repository strings five of
the operators together.
"""
