"""Column expressions: text measures, paths, classification rules and formatters. All run inside the JVM."""
