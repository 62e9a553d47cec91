"""Portfolio-KPI analytics as DataFrame operators on Spark."""
