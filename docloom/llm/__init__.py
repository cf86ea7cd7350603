"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it. Every operator takes DataFrames and
returns a DataFrame with a fixed set of columns; other input columns are ignored,
so extra columns never clash with results.
"""
