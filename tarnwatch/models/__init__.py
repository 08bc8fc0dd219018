"""Fitted models on MLlib: trend plus trees, quantile forecasts, classifiers, soft sensors, isolation forest."""
