"""Operations of a training-data pipeline over the ``documents`` and ``pages`` tables.

Nothing outside this subpackage imports it, and it needs nothing but Spark, numpy, pyarrow and the
libraries that each module names.  See the README for the method and the limits of every operator.
"""
