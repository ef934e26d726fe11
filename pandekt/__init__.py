"""pandekt: document retrieval and retrieval evaluation as PySpark jobs.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing is executed until the caller runs an action, apart from the
few size checks named in the docstrings.
"""
