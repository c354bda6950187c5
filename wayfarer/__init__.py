"""Wayfarer: customer-experience analytics as PySpark DataFrame operators.

Operators take a DataFrame and column names and return a lazy DataFrame; the
few that must look at data while a plan is built (distinct values of a pivot,
candidate itemsets, model fits) say so in their docstring.
"""

__version__ = "0.1.0"
