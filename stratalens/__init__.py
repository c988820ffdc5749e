"""stratalens: filing-fragility and identity-drift analytics as Spark DataFrame plans."""
