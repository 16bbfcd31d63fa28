"""Jobs on tables of cells, days, months and seasons; DataFrames in, DataFrames out."""
