"""Relational operators over facts: DataFrame in, DataFrame out."""
