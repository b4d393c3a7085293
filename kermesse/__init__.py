"""Kermesse: cleaning, profiling and exact vector search of event records on Spark."""
