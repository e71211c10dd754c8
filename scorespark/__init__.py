"""Spark-native analytics over symbolic music-score data.

Token tables, window operators, corpus preparation, prediction scoring and page-layout joins, all expressed as
DataFrame plans.
"""
