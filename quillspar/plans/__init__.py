"""The query catalogue: each query over the tables of a folder, with the DuckDB SQL that gives the same rows."""
