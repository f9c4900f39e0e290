"""tidemark: listing tracking over web-page snapshots, expressed as Spark DataFrame plans."""
