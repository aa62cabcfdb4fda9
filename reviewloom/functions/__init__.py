"""Column expressions: no shuffle, no Python worker, usable in any plan."""
