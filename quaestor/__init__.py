"""Insurance portfolio analytics as composable Spark DataFrame functions."""
