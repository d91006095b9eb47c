"""Takes nested data apart with Spark: canonical JSON text, bracket levels and linked trees of nodes."""
