"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; `inquest.llm.queries` registers
the operators' queries with `__spark_entry__`.
"""
