"""Column-expression helpers (pure ``pyspark.sql.functions``, no UDFs)."""
