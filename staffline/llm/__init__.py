"""Operators for preparing text corpora.

One module per operator; ``queries`` registers one thin query for each of
them. Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
