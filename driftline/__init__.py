"""Trajectory analytics on Spark: composable DataFrame operators for timestamped position fixes."""
