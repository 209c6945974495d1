"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, works from whole tables and whole texts, and keeps what it must
share between jobs in the folder that ``spark.checkpoint.dir`` names.
"""
