"""The given tables in the library's terms, and the SQL to check results with."""
