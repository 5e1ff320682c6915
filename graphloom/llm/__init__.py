"""Training-data operators: dedup, formatting, tokens, decontamination, extraction, toxicity.

Nothing outside this subpackage imports it.
"""
