"""Operators of a training-data pipeline.

Each module holds one operator with a general interface; ``queries`` holds
the thin registered queries and their DuckDB SQL.  Nothing else in the
library imports this subpackage.
"""
