"""Table and stream jobs for operational data on Spark."""
