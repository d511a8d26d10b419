"""Operators that prepare text corpora for model training.

Nothing outside this subpackage imports it; deleting the folder leaves the rest of the library whole.
"""
