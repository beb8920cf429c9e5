"""Readers and writers: given tables, the derived customer snapshot, tenant
files (CSV / parquet), schema conformance, tenant-partitioned tables."""
