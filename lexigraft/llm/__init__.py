"""Training-data operators: ten self-contained components over text and vectors.

Nothing outside this package imports it, so it can be removed as a whole.
"""
