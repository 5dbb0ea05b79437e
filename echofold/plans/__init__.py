"""Named queries over the tables, with the SQL that says the same."""
