"""Training-data operators: search, token files, language, deduplication, decontamination,
quality, token counts, personal data and packing.

Nothing outside this subpackage imports it.
"""
