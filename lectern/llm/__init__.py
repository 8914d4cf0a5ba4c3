"""Operators that turn a research library into training data.

Nothing else in the package imports this one; removing the folder leaves the
rest working.
"""
