"""Knowledge-graph analytics over research-paper records, expressed as Spark jobs."""
