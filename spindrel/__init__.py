"""spindrel: mention detection and entity linking as Spark DataFrame plans."""
