"""episodia: episodic time-series and embedding analytics as Spark plans."""
