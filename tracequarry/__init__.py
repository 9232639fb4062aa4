"""Event-log analytics on Spark: an event model, a pipeline query language, forensic analytics and rules."""
