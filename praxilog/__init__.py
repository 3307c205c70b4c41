"""Learning analytics over practice attempts, as Spark plans."""
