"""shopsight.streaming."""
