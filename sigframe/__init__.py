"""sigframe: point-in-time panel analytics expressed as Spark plans."""
