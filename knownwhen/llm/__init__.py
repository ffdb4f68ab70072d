"""Operators for the corpora of language models. Nothing else in the library imports this subpackage."""
