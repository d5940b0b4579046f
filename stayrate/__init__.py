"""stayrate: churn and price-sensitivity analytics as Spark DataFrame operators.

Every operator takes DataFrames plus parameters and returns a DataFrame built
from native column expressions or Spark ML, so Catalyst sees the whole plan.
"""
