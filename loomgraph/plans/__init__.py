"""The SQL gate and the registered queries with their SQL."""
