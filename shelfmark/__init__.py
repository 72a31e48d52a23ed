"""File-inventory analytics on Spark: scan, classify, name, plan, resolve, execute, report."""
