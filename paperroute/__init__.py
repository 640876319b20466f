"""Document-intake analytics as Spark jobs.

Operators are functions from DataFrames to DataFrames.  ``operators`` holds the batch jobs,
``streaming`` runs the same jobs on streams, ``sources`` and ``sinks`` read and write files,
``functions`` has column expressions, ``plans`` wires operators into the registered queries.
"""
