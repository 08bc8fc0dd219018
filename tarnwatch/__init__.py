"""tarnwatch: water and air station analytics as ordinary Spark DataFrame operators."""
