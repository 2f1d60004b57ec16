"""docweave: corpus-scale document structuring as Spark DataFrame transforms."""
