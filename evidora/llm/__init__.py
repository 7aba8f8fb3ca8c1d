"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; NumPy and Arrow are used only inside tasks, on bounded blocks of
text.
"""
