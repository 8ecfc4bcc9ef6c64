"""Operators for preparing large text and vector collections for training.

Each module holds one operator with its own general interface; ``queries``
registers the thin ``opN_<name>`` queries over them. Nothing outside this
subpackage imports it, apart from the pipeline and the query registry.
"""
