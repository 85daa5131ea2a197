"""Sluice: a Spark-native engine for seeded data generation, latency analytics and relational workloads."""
