"""Clinical transport files and large text corpora on Spark."""
