"""Event-rule and campaign analytics expressed as Spark plans."""
