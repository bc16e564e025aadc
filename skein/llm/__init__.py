"""Training-data operators: media columns, language models, deduplication, packing, archives.

Nothing outside this subpackage imports it; it may be removed as a whole.
"""
