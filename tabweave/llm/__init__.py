"""Operations of a training-data pipeline over text, page and vector tables.

Nothing outside this package imports it.  ``queries`` registers one query per
operator; ``scratch`` and ``graph`` are shared by the operators.
"""
