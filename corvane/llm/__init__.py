"""Operators for preparing training text at scale.

Nothing outside this folder imports it.  Each module holds one operator with
its own general interface; :mod:`corvane.llm.queries` holds the thin queries.
"""
