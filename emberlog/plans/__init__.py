"""Input views over the test tables, the queries on them, and the same queries in SQL."""
