"""quadrat - field-survey analytics on Spark.

Hierarchical survey data (island > site > plot > quadrat/transect, by sampling
year) summarised with lazy DataFrame plans: nested mean and standard error,
size-class histograms, share of total, wide/long reshaping by name pattern,
period-over-period change, natural joins with R's NULL rules, line-intersect
volume and mass, and report tables built from them.

Layout: ``functions`` (Column expressions), ``operators`` (generic DataFrame
operators), ``sources`` (schemas, readers, writers, driver-table roles),
``plans`` (the survey's composite analyses) and ``streaming`` (none needed).
"""

__version__ = "0.1.0"
