"""Operations of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage; ``entry.py`` in it holds
the registered queries.
"""
