"""Training-data operators: filtering, scoring, search, extraction and output of text corpora.

Nothing else in the library imports this subpackage.
"""
