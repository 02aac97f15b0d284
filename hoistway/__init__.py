"""hoistway: lift-traffic analytics as Spark DataFrame plans."""
