"""Column expressions shared by the reports; all run inside the JVM."""
