"""Reading SQL scripts, table schemas and lineage files as DataFrames."""
