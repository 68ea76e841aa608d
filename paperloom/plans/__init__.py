"""Named queries over the benchmark tables, and SQL that says the same."""
