"""Training-data operators for large corpora.

Self-contained: nothing else in the library imports this subpackage. ``queries`` holds the registered
queries and their SQL; every other module is one operator with a general interface.
"""
