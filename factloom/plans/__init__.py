"""Facts from relational tables, and passes of several operators."""
