"""Column-in, column-out building blocks; all of them run inside the JVM."""
