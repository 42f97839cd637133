"""The queries and the SQL they are compared with."""
