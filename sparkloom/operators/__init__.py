"""Relational operators that Spark SQL lacks, as compositions of DataFrame operations."""
