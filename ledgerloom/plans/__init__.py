"""Plan shapes shared by the operators: hot keys, running totals, work folders."""
