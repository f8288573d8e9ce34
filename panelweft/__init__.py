"""Panel forecasting, evaluation and text-corpus preparation on Spark."""
