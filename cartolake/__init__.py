"""cartolake: place, review and mention analytics as Spark DataFrame operators."""
