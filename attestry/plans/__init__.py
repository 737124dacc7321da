"""The query catalogue, and the same queries in DuckDB SQL."""
