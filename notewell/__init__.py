"""Search and analytics over corpora of text notes, as Spark plans."""
