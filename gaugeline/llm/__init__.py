"""Training-data operators: ten self-contained components over a ``documents`` table.

Nothing outside this subpackage imports it, and it imports nothing from the rest of the library.
"""
