"""Layout instances derived from relational tables."""
