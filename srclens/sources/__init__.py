"""Sources: source-file tables from directories or tables, and synthetic
corpora derived with Spark from the driver's test tables."""
