"""loglens: conversation-log and document analytics on Spark DataFrames.

Every public operator is a ``DataFrame -> DataFrame`` function (use it with
``df.transform``) or a reader returning a DataFrame.  Nothing is collected to
the driver; user callables (encoders, completion functions) run inside
Arrow-batched Python tasks.
"""

__version__ = "0.1.0"
