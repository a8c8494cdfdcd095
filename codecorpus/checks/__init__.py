"""Every operator as a query over the given tables, and the same answer in plain SQL."""
