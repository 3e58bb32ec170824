"""Operators for preparing training data: near duplicates, media, licences, secrets, packing,
tokenizing, language, page text and web archives.

Nothing else in the library imports this subpackage. Each operator takes DataFrames and returns a
lazy DataFrame unless its docstring says that it runs jobs of its own.
"""
