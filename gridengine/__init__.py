"""Spreadsheet-shaped analytics on Spark DataFrames."""
