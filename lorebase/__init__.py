"""lorebase: typed-record retrieval, hygiene and analytics as Spark DataFrame jobs."""
