"""bitweave: analytics over binary hypervector memories, expressed as Spark plans."""
