"""Market-analytics engine on PySpark: operators, sources, functions, plans and streaming."""
