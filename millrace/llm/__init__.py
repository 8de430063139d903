"""Training-data operators: search, scanning, dedup, mixing, language, quality, LM scoring, BPE.

Nothing outside this subpackage imports it.
"""
