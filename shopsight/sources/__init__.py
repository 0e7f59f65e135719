"""shopsight.sources."""
