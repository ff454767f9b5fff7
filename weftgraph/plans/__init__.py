"""The query language: parser, plans, and their execution as DataFrames."""
