"""The formula language: expressions in a small JavaScript-like syntax over a row's fields, with exact decimals and errors as data."""

from larkspur.functions.formula.syntax import FormulaError, Limits, parse

__all__ = ["FormulaError", "Limits", "parse"]
