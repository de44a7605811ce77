"""Operators over DataFrames: chunking, retrieval, parameters, synchronisation, reports and answers."""
