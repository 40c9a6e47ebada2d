"""Column functions that Spark lacks, as compositions of those it has."""
