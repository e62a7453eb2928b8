"""Training-data operators: ten corpus operators, each in a module of its own.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and returns
DataFrames; ``registry`` binds them to the tables of a data folder.
"""
