"""Operators put together: the scheduled refresh, the report views, the query catalogue."""
