"""Column-expression builders.  Everything here returns a ``pyspark.sql.Column`` built from
built-in functions, so it stays inside whole-stage codegen / the JVM."""
