"""Operators for preparing large text corpora.

Nothing outside this subpackage imports it.  Every module holds one operator
with its own general interface; :mod:`quillstat.llm.queries` holds the thin
digest queries over the test tables and the SQL they are compared with.
"""
