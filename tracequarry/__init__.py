"""Analytics over append-only event logs, as Spark DataFrame queries."""
