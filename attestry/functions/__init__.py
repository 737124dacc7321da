"""Scalar functions over facts: Column in, Column out, without Python UDFs."""
