"""Operators for preparing language-model training data at scale.

Nothing outside this folder imports it. Each module holds one operator with a
general interface; ``queries`` binds them to the tables under the contracts.
"""
