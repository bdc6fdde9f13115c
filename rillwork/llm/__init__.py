"""Training-data operators: tokenising, filtering, deduplicating, scanning and mixing text corpora.

Nothing else in the library imports this subpackage. Every operator takes a DataFrame, selects only the
columns it needs (so clashing extra columns are harmless) and returns a DataFrame; models and vocabularies
are loaded or fitted here, never shipped with the repository.
"""
