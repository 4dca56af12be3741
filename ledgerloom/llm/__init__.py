"""Training-data operators: dedup, scans, quality, chat formatting, decontamination and tokenization.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
