"""Relational operators: words, classifiers, trees, neighbours, splits, reports."""
