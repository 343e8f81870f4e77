"""Spark-native curation and analytics for collections of web pages and documents."""
