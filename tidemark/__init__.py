"""tidemark: point-in-time, cross-sectional analytics over daily series on Spark.

Every operator takes DataFrames and returns a DataFrame (or a ``Checked`` pair of
clean rows and violations).  No operator triggers a job unless its name says so
(``write_*``, ``append_*``, ``upsert_*``, ``Checked.require``, ``settled``); scoring and
ranking settle what they read several times in the shared folder.
"""
