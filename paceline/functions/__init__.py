"""Column → Column helpers; nothing here triggers a job or leaves the JVM."""
