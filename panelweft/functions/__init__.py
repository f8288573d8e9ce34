"""Part of the panel forecasting and evaluation library."""
