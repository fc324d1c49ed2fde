"""Tolerant recognisers of declarations, imports and scopes in seven languages.

Sources are bytes, read as Latin-1 so that places in the text are byte offsets.
"""
