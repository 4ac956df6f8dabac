"""Operators for preparing large training corpora.

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
adds its queries when the folder is present.
"""
