"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from lanefold.llm import cooccurrence, groups, leakage, names, packing, pairs, ranking, spam, vectors

MODULES = [pairs, names, cooccurrence, groups, vectors, ranking, packing, leakage, spam]
