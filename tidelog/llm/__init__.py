"""Training-data operators: ten methods over the documents, benchmark and pages tables.

Nothing else in the library imports this subpackage.
"""
