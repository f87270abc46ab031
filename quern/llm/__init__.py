"""Training-data operators: dedup, privacy, tokens, packing and language.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
when it is present.
"""
