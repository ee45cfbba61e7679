"""Training-data operators: deduplication, decontamination, tokenisation, archives.

Nothing outside this subpackage imports it.
"""
