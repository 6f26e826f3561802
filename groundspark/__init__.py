"""groundspark: Spark jobs for the data side of visually grounded word learning."""
