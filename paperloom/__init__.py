"""Document, transcript and task processing as Spark plans."""
