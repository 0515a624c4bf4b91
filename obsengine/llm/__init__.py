"""Operators that prepare text, page and vector tables for training language models.

Every module holds one operator with a general interface; `obsengine.llm.queries` applies each to its table.
Nothing outside this package imports it.
"""
