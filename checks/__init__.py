"""SQL statements that state independently what the queries must return."""
