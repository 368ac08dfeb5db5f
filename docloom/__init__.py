"""Document analytics on Spark: parse, detect, chunk, enrich, sync, verify and retrieve as DataFrame plans."""
