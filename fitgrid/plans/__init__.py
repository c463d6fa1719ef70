"""Plan shapes shared by the operators: joins, selection, running totals."""
