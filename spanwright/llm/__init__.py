"""Training-data operators: near-duplicates, language, licences, archives, mixing.

Nothing outside this subpackage imports it; its queries are registered by
``spanwright.llm.registry``.
"""
