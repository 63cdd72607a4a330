"""Spark-native analytics over chunked source trees and documents."""

__version__ = "0.1.0"
