"""Table operators. Every function takes and returns lazy DataFrames."""
