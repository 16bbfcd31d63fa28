"""Jobs on files that keep arriving."""
