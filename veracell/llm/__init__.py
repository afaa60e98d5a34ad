"""Operators for large text corpora: dedup, quality, privacy, tokens, chat.

Nothing outside this folder imports it; the registry in ``queries.py`` is added
to the repository's queries only where the folder exists.
"""
