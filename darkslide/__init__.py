"""PySpark-native analytics over cloud photo-library exports.

Operators are pure ``DataFrame -> DataFrame`` functions; see the README for the map of the package.
"""
