"""shopsight.plans."""
