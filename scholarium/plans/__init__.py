"""Composed plans: the metrics layer, the SQL guard, access rules and the query catalog."""
