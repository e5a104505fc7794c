"""Savings measurement and verification for demand-response programmes on Spark.

Layout
------
``functions``  column expressions: missing-value rules, clocks, meter ids
``sources``    CSV tables, JSON model documents, report sinks
``operators``  null-safe joins, exact quantiles, reproducible draws
``plans``      the analyses: event savings, meter reads, model comparison, samples
``jobs``       file-in, file-out runs of whole analyses
``inputs``     projections of the test tables into the shapes the plans expect
``oracle``     the same questions written as plain SQL, for checking
"""
