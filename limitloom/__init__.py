"""Credit-limit portfolio analytics as composable PySpark DataFrame operators."""
