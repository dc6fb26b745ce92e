"""photonlake: image-metadata analytics and corpus preparation as Spark jobs."""
