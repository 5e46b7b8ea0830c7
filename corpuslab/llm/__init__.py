"""Operators for training-data pipelines, on top of the tables of a text corpus.

One module per operator; ``queries`` registers one query per operator and the
pipeline. Nothing outside this folder imports it (``__spark_entry__.py`` adds its
queries only if it is there).
"""
