"""Spark jobs that clean, resample, join and score energy time series of many meters and sites."""
