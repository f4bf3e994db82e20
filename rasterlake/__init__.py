"""Figure-reconstruction and corpus analytics expressed as Spark plans."""
