"""Table operators: DataFrames in, DataFrames (or a replacing Column) out."""
