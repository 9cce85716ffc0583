"""Plans over the test tables: derived inputs, and the registered queries with their SQL."""
