"""Training-data operators over the ``documents`` and ``pages`` tables.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it can be imported.
"""
