"""Training-data operators: dedup, secrets, language models, quality, tokens, mixing, media and URL rules.

Nothing else in the library imports this subpackage; the entry point adds its queries only when it is present.
"""
