"""shopsight.functions."""
