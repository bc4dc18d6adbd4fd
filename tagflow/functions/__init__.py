"""Column expressions: everything here compiles to JVM expressions (whole-stage codegen)."""
