"""Every operator as a query over the given tables, with the SQL that must return the same rows."""
