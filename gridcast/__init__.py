"""Spark-native preparation, forecasting and evaluation of many parallel time series."""
