"""mailsift: e-mail threat analytics expressed as Spark DataFrame plans.

Layout
------
functions/   Column -> Column expressions (cleaning, features, domains, scores)
operators/   DataFrame -> DataFrame operators (corpus, splits, TF-IDF, models,
             metrics, explanations)
sources/     readers, sinks and the derived fixture views
plans/       end-to-end jobs and the registry of checked queries
streaming/   Structured Streaming scoring
"""

__version__ = "0.1.0"
