"""corvane: retrieval and analytics over text collections, expressed as Spark plans."""
