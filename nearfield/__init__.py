"""Metric similarity search as Spark jobs: distances, range and nearest-neighbour
queries, and a pivot-based multi-level partitioning index kept in Parquet."""
