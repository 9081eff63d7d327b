"""Marketplace analytics and question-answering data jobs as Spark DataFrames.

Layout: ``functions`` holds column expressions, ``operators`` DataFrame-to-DataFrame
jobs, ``plans`` the metric layer, ``sources`` readers and sinks, ``streaming``
the Structured Streaming versions, and ``queries`` the runnable catalogue.
"""
