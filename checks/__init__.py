"""SQL statements the queries are checked against."""
