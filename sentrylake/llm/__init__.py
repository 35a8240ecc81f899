"""Training-data operators: one module per operator, each over plain DataFrames.

Nothing else in the library imports this subpackage.
"""
