"""Operators for preparing language-model training data.

Nothing else in the library imports this package; it needs only Spark, numpy,
Arrow and the tokenizer and compression libraries named in each module.
"""
