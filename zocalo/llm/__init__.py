"""Operators for preparing training text, each built by one named method; their queries are in ``zocalo.llm.queries``."""
