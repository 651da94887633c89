"""What the dialect's functions, aggregates and window functions are in Spark SQL: text for Catalyst, no Python at run time."""
