"""Operators that prepare large text corpora for training, and their registered queries."""
