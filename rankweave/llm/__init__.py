"""Operators for preparing training text, one module per operator.

Nothing outside this folder imports it.  ``queries`` binds the operators to the tables; ``common`` holds what several
of them share: reading a table, naming a row, cutting large groups into pairs of blocks.
"""
