"""lexisift: text-moderation analytics as Spark DataFrame plans."""
