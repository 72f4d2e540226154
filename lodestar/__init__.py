"""Record linkage, candidate matching, panels, metrics and resampling as Spark plans."""
