"""Column functions: every function takes and returns Spark columns and stays inside the JVM."""
