"""Training-data operators: one module per operator, each a DataFrame-to-DataFrame function.

Nothing outside this subpackage imports it; `__spark_entry__.py` adds its queries when it is present.
"""
