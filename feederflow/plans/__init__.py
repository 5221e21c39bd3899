"""Assembly of optimisation models as tables, and their solution."""
