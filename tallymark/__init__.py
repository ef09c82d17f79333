"""Data reconciliation and quality checks as Spark DataFrame operators."""
