"""Registered queries over the test tables, each with its SQL twin where one can be written.

A module holds ``QUERIES``: name -> (callable(spark, folder), SQL text or None).
"""
