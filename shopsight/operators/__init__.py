"""shopsight.operators."""
