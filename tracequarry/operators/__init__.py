"""Detectors and relational operators, each a function of DataFrames."""
