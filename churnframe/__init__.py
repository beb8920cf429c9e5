"""churnframe: customer-retention analytics as Spark DataFrame jobs.

sources    read tenant tables, derive the customer snapshot, validate,
           conform schemas, write tenant-partitioned tables
functions  column expressions shared by the operators
operators  cleaning, encoding, splitting, distributed ordering, ranking,
           backtest, metrics, trained models, explanations, segments,
           anomalies, survival, feedback, reports
plans      registered queries and their DuckDB oracle SQL
streaming  the row-local cleaning and scoring on Structured Streaming
"""
