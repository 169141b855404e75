"""Training-data operators: token counts, language-model scoring, quality, language id, BPE,
nearest neighbours, substring and near-duplicate removal, packing and exact top-k search.

Nothing outside this subpackage imports it.
"""
