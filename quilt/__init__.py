"""quilt: partitioned sparse linear algebra and graph ranking on Spark."""
