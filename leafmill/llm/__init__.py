"""Operators for preparing language-model training corpora.

Nothing else in ``leafmill`` imports this subpackage; ``llm.registry`` lists its queries and their SQL.
"""
