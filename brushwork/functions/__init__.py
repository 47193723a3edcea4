"""Scalar functions: Column builders only, no Python UDFs."""
