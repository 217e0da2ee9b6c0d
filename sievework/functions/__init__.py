"""Column-level building blocks; each returns a Column and never runs a job."""
