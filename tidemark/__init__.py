"""tidemark: declarative conditions, upserts, change capture and fan-out on Spark."""
