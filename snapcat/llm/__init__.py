"""Operators of a training-data pipeline; nothing else in the library imports this package.

Every operator maps a frame of documents to a frame. The id and text columns are parameters; other
columns of the input are ignored or carried, so their names cannot clash. Result columns that a
document frame already has are replaced.
"""
