"""Relational operators: graph, vectors, evaluation, sampling, folds."""
