"""factlake: bitemporal facts as Spark jobs."""
