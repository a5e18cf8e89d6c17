"""Training-data operators: quality, licences, tokens, packing, deduplication, URLs.

Every operator is a function from DataFrames to DataFrames in a module of its
own; ``queries`` registers one production query for each.  Nothing else in the
library imports this subpackage.
"""
